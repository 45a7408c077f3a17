"""Personal data in free text: spans, scores and placeholders (problem 1).

Patterns propose spans, checksums confirm them, words beside them move the
score, and spans that reach ``ACCEPT`` become placeholders of their type; where spans overlap the one with the
higher score stands. A check that every number of a kind has to pass rejects those that fail (cards, bank
accounts). For national numbers a check only adds to the score: people mistype them, and the invented
ones of examples fail on purpose, so one that fails stands if its shape or the words before it say enough. Every
text is read whole and once, in Arrow batches; there is no shuffle.

Matching runs on a copy of the text in which decimal digits are ASCII, odd
spaces are plain and letters are composed; spans are mapped back, so the rest
of a text stays exactly as it was.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.frames import carry, restore
from tidegraph.functions.text import DIGITS
from tidegraph.session import ship

TYPES = ("email", "phone", "identity_number", "street_address", "person_name")
ACCEPT = 0.5
#: Scores by shape of what has no check; numbers have theirs beside their patterns.
EMAIL_SCORE, ADDRESS_SCORE, NAME_SCORE = 2.0, 1.4, 0.6
#: Largest tables of names and sample texts that are shipped to the workers.
MAX_NAMES, MAX_SAMPLES = 200_000, 50_000
#: Characters before and after a span in which words count as its context.
BEFORE, AFTER = 32, 20

# -- one copy of the text for matching --------------------------------------------------------------

_SAME_LENGTH = {ord(c): "0123456789"[i % 10] for i, c in enumerate(DIGITS)}
_SAME_LENGTH |= {ord(c): " " for c in " ﻿            　\t\r"}
_SAME_LENGTH |= {ord("ي"): "ی", ord("ك"): "ک", ord("ى"): "ی", ord("＠"): "@", ord("﹫"): "@", ord("’"): "'", ord("‑"): "-", ord("–"): "-", ord("＋"): "+"}
_CLUSTER = re.compile(r"(?s).[̀-ͯٓ-ٕ]*")


def _composed(text: str) -> tuple[str, list[int] | None]:
    """The text in composed letters, and for each of its characters the place in ``text`` (None: the same)."""
    if unicodedata.is_normalized("NFC", text):
        return text, None
    out, places = [], []
    for m in _CLUSTER.finditer(text):
        c = unicodedata.normalize("NFC", m.group())
        out.append(c)
        places += [m.start()] * len(c)
    return "".join(out), [*places, len(text)]


# -- checksums --------------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def nir_key(d: str) -> bool:
    """Thirteen places and a key of two: what is left to 97; the two halves of Corsica count as 19 and 18."""
    if len(d) != 15:
        return False
    body = d[:5] + {"2A": "19", "2B": "18"}.get(d[5:7].upper(), d[5:7]) + d[7:13]
    return body.isdigit() and 97 - int(body) % 97 == int(d[13:])


def tax_eleven(d: str) -> bool:
    """The eleven-digit tax number with a check digit by products modulo 11 and 10."""
    product = 10
    for c in d[:10]:
        product = ((int(c) + product) % 10 or 10) * 2 % 11
    return int(d[10]) == (11 - product) % 10


def social_area(d: str) -> bool:
    """Groups that a number given out has: no 000, 666 or 9.. in front, no zeros in the other groups."""
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def insurance_prefix(d: str) -> bool:
    """Letters that a number given out begins with."""
    a, b = d[0].upper(), d[1].upper()
    return a not in "DFIQUV" and b not in "DFIQUVO" and a + b not in ("BG", "GB", "KN", "NK", "NT", "TN", "ZZ")


def national_ten(d: str) -> bool:
    """The ten-digit code whose last digit is a weighted sum modulo 11."""
    r = sum(int(c) * (10 - i) for i, c in enumerate(d[:9])) % 11
    return int(d[9]) == (r if r < 2 else 11 - r)


def national_eleven(d: str) -> bool:
    """The eleven-digit code with two check digits modulo 10."""
    n = [int(c) for c in d]
    return (sum(n[0:9:2]) * 7 - sum(n[1:8:2])) % 10 == n[9] and sum(n[:10]) % 10 == n[10]


def two_checks(d: str) -> bool:
    """The eleven-digit taxpayer code with two check digits modulo 11."""
    for k in (9, 10):
        r = sum(int(c) * (k + 1 - i) for i, c in enumerate(d[:k])) * 10 % 11 % 10
        if r != int(d[k]):
            return False
    return True


def check_letter(d: str) -> bool:
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(d[:8]) % 23] == d[-1].upper()


# -- patterns ---------------------------------------------------------------------------------------

_EMAIL = re.compile(r"(?<![\w.+@-])[A-Za-z0-9][\w.+%-]*(?:@| @ )[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,24}(?![\w@])", re.A)
_EMAIL_SPELT = re.compile(
    r"(?<![\w.+@-])[A-Za-z0-9][\w.+%-]*"
    r"(?: ?[\[({] ?at ?[\])}] ?[\w-]+(?:(?: ?[\[({] ?dot ?[\])}] ?| dot |\.)[\w-]+)*(?: ?[\[({] ?dot ?[\])}] ?| dot |\.)[A-Za-z]{2,24}"
    r"| at [\w-]+(?:(?: ?[\[({] ?dot ?[\])}] ?| dot )[\w-]+)+)(?!\w)",
    re.A | re.I,
)

#: What a spelt e-mail holds one of, in lower case.
_AT = (" at ", *(f"at{gap}{end}" for gap in ("", " ") for end in ")]}"))
#: What the patterns below need: seven digits near each other, letters before six digits (letter8), or the groups of nino and iban.
_SEVEN = re.compile(r"\d(?:[ .()\-/]{0,3}\d){6}")
_LETTERS_SIX = re.compile(r"(?<!\w)[A-Z]{1,2} ?\d{6}", re.I)
_THREE_PAIRS = re.compile(r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]\b|[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3}")
_IDENTITY = (
    # name, pattern, score by shape, checksum
    ("ssn", re.compile(r"(?<![\w.-])\d{3}([- ])\d{2}\1\d{4}(?![\w-]|\.\d)"), 0.5, social_area),
    ("cpf", re.compile(r"(?<![\w.-])\d{3}\.\d{3}\.\d{3}-\d{2}(?![\w-])"), 1.06, two_checks),
    ("dni", re.compile(r"(?<![\w.-])\d{8}-?[A-ZÑa-zñ](?![\w-])"), 0.3, check_letter),
    ("nino", re.compile(r"(?<!\w)[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?!\w)"), 0.5, insurance_prefix),
    ("nir", re.compile(r"(?<![\w.-])(?:\d(?: \d{2}){2} \d[\dABab] \d{3} \d{3}(?: \d{2})?|\d{13}(?:\d{2})?)(?![\w-])"), 0.2, nir_key),
    ("grouped11", re.compile(r"(?<![\w.+-])\d{2} \d{3} \d{3} \d{3}(?![\w-])"), 0.3, tax_eleven),
    ("letter8", re.compile(r"(?<!\w)[A-Z]{1,2} ?\d{6,9}(?!\w)", re.I), 0.0, None),
    ("ten", re.compile(r"(?<![\w.+-])\d{10}(?![\w-])"), 0.0, national_ten),
    ("tens", re.compile(r"(?<![\w.+-])\d{3}[- ]\d{6}[- ]\d(?![\w-])"), 0.3, national_ten),
    ("eleven", re.compile(r"(?<![\w.+-])\d{11}(?![\w-])"), 0.0, national_eleven),
    ("sixteen", re.compile(r"(?<![\w.+-])\d{16}(?![\w-])"), 0.0, None),
    ("card", re.compile(r"(?<![\w.+-])\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?![\w-])"), 0.0, luhn),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"), -0.2, mod97),
)
#: Kinds of which every number passes its check: those that fail are none.
_MUST_PASS = {"card", "iban"}
#: What a passed check adds to the score, where it is more than a hint.
_CONFIRMED = {"iban": 0.8, "card": 0.5, "dni": 0.3, "tens": 0.3, "nir": 0.3}
_IDENTITY_WORDS = re.compile(
    r"(?:\bssn\b|social|insurance|passport|passeport|pasaporte|passaporte|pasaport|paspor|reisepass|ausweis|\bid(?: card)?\b|identity|\bdni\b|\bnie\b|\bnif\b|\bcpf\b|\brg\b|"
    r"s[ée]curit[ée] sociale|\bnir\b|steuer(?:-id)?|\btc\b|kimlik|\bnik\b|\bktp\b|[ck]ode? ?melli|shomare ?melli|shenasname|کد ?ملی|شماره ?ملی|شناسنامه|گذرنامه|پاسپورت|"
    r"رقم الهویة|الهویة|البطاقة(?: الوطنیة)?|جواز(?: السفر)?|\biban\b|taxpayer|identidad|identidade|identit[ée])(?:[ -]?(?:number|no|nr|numara\w*|n[úu]mero|num[ée]ro)\b)?",
    re.I,
)
#: Words of things that have numbers but are no persons; they count only right before a number.
_NOT_PERSONAL = re.compile(
    r"ticket|\border|\bserial|status|tracking|invoice|\broom\b|\bchart|bilet|entrada|ingresso|billet|\bkarte\b|tiket|belit|pedido|commande|bestell|sipari[sş]|pesanan|بلیت|پست|سفارش|تذکرة|منشور|طلب|"
    r"\bpost\b|publicaci[óo]n|\bseri\b|\bupdated|\bsince\b|\bscore|\bskor",
    re.I,
)
OTHER_WITHIN = 12
#: Ways to write a phone number, each with its score by shape; groups are bounded so that a count after it is not drawn in.
_PHONES = tuple(
    (re.compile(rf"(?<![\w.@/+\-])(?:tel: ?)?{p}(?![\w]|[.\-]\d)", re.I), score)
    for p, score in (
        (r"\(?(?:\+ ?|00 ?)1[ .\-]?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4}", 0.7),
        (r"\(?(?:\+ ?|00 ?)44[ .\-]?(?:\(0\) ?)?\d{4}[ .\-]?\d{3}[ .\-]?\d{3}", 0.7),
        (r"\(?(?:\+ ?|00 ?)98[ .\-]?\d{2,3}[ .\-]?\d{3,4}[ .\-]?\d{4}", 0.7),
        (r"\(?(?:\+ ?|00 ?)49[ .\-]?(?:\(0\) ?)?\d{2,4}[ .\-/]?\d{4,8}", 0.7),
        (r"\(?(?:\+ ?|00 ?)\d{1,3}[ .\-]?(?:\(0\) ?)?\(?\d{1,4}\)?(?:[ .\-]\d{2,4}){2,4}", 0.7),
        (r"\+ ?\d{9,14}", 0.7),
        (r"00\d{10,13}", 0.5),
        (r"\(?\d{3}\)?[ .\-]?(?<=[ .\-)])\d{3}[.\- ]\d{4}", 0.5),
        (r"\(0\d{1,4}\)[ \-]?\d{3,4}[ \-]?\d{3,4}", 0.5),
        (r"07\d{3} \d{3} ?\d{3}", 0.5),
        (r"0\d(?:[ .]\d{2}){4}", 0.5),
        (r"0\d{2}-\d{4}[ \-]?\d{4}", 0.5),
        (r"0\d{2,4}/\d{4,6}-\d{1,4}|0\d{2,4} \d{5} \d{3}", 0.5),
        (r"0\d{2,4}[ /\-]\d{5,8}", 0.3),
        (r"0\d{9,10}", 0.2),
        (r"\d{3} \d{3} \d{3}|\d{3} \d{2} \d{2} \d{2}|\d{4}-\d{4}", 0.2),
        (r"\d{9,11}", 0.2),
    )
)
_PHONE_WORDS = re.compile(
    r"\btel|phone|whats ?app|\bcall\b|reach|\bsms\b|\btext me|mobile|\bcell\b|number|nummer|\bruft|\bruf\b|anruf|num[ée]ro|n[úu]mero|appel|ll[áa]m|telef|t[ée]l[ée]ph|ligue|liguem|celular|m[óo]vil|"
    r"\bara(?:y[ıi]n)?\b|numara|telepon|nomor|hubungi|\bhp\b|\bwa\b|تلفن|شماره|تماس|پیام|موبایل|زنگ|اتصل|رقم|هاتف|جوال|واتس|shomare|zang|payam|tamas|mobail",
    re.I,
)
_W = r"[^\W\d_]+(?:['\-][^\W\d_]+)*"
_CAP = r"[^\W\d_a-zа-я][^\W\d_]*(?:['\-][^\W\d_]+)*"
_NO = r"(?:n\.? ?[º°o]\.? ?|no?\.? ?|num(?:ber|éro|ero)? |nº ?|# ?)?"
#: Substrings of which one must occur (in lower case), and the pattern that is then tried.
_ADDRESS = tuple(
    (tuple(gates.split("|")), re.compile(p, re.I))
    for gates, p in (
        ("box", rf"\bP\.? ?O\.? ?Box \d+(?:, {_W}(?: {_W})? \d+)?"),
        # number first, kind last, with flat before or after
        (
            "street| st|,st|road| rd|,rd|lane| ln|,ln|ave|crescent| close|,close|court| ct|,ct|drive| dr|,dr|boulevard|blvd|terrace| way|,way|place|square|garden|grove| row|,row|mews",
            rf"(?:(?:flat|apt\.?|apartment|unit|suite) ?\d+[a-z]?,? )?(?<![\w.\-])\d{{1,5}} ?[a-h]?,? (?:[NSEW]\.? )?{_W}(?: {_W})?[ ,](?:street|st|road|rd|lane|ln|avenue|ave|crescent|close|court|ct|drive|dr|boulevard|blvd|terrace|way|place|square|gardens|grove|row|mews)\b\.?(?:,? (?:flat|apt\.?|apartment|unit|suite) ?\d+ ?[a-z]?)?",
        ),
        # kind first, number last
        (
            "calle|c/|avda|avenida|av|plaza|paseo|camino|carretera|ronda|trave|rua|r.|alameda|pra|largo|estrada|rodovia",
            rf"\b(?:calle|c/|avda\.?|avenida|av\.?|plaza|paseo|camino|carretera|ronda|traves[íi]a|rua|r\.|travessa|alameda|pra[çc]a|largo|estrada|rodovia)\s?(?:de |del |de la |da |do |das |dos )?{_W}(?: {_W})?,? ?{_NO}\d+(?:,? ?\d+ ?[º°ª]? ?[a-z]?\b|,? (?:apto|ap|piso|bloco|casa|puerta)\.? ?\w+)?",
        ),
        # the number before the kind, as in French
        (
            "rue|avenue|av.|boulevard|bd|place|impasse|quai|all|chemin|cours|square|route|passage",
            rf"(?<![\w.\-])\d{{1,5}}(?: ?(?:bis|ter|quater))?,? (?:rue|avenue|av\.|boulevard|bd|place|impasse|quai|all[ée]e|chemin|cours|square|route|passage)(?: de la| de| du| des| d'| l'| la| le)? ?{_W}",
        ),
        (
            "str|weg|platz|gasse|allee|damm|ufer|ring",
            rf"\b(?:[^\W\d_]+(?:stra(?:ß|ss)e|str\.|weg|platz|gasse|allee|damm|ufer|ring)|(?:[^\W\d_]+er )(?:Stra(?:ß|ss)e|Weg|Platz|Allee)) \d+ ?[a-z]?\b(?:,? (?:Hinterhaus|Vorderhaus|\d+\. Stock))?",
        ),
        (
            "mah|sok|cad|bulvar",
            rf"\b{_W} (?:mah\.?|mahallesi),? {_W}(?: {_W})? (?:sok\.?|soka[kğ][ıi]?|cad\.?|caddesi|bulvar[ıi]),? (?:no:? ?)?\d+(?:,? ?(?:d|daire|kat|k):? ?\d+)*|\b{_W} (?:sok\.?|soka[kğ][ıi]?|cad\.?|caddesi|bulvar[ıi]),? (?:no:? ?)\d+(?:,? ?(?:d|daire|kat|k):? ?\d+)*",
        ),
        ("jl|jalan|gang|gg", rf"\b(?:jl\.?|jln\.?|jalan|gang|gg\.?) {_W}(?: {_W})?,? (?:no(?:mor)?\.? ?)\d+(?:,? ?RT ?\d+ ?/ ?RW ?\d+)?"),
        (
            "پلاک|شماره|واحد",
            rf"(?:(?:میدان|خیابان|بلوار|کوچه|کوی|بزرگراه|محله|شهرک) {_W}(?: {_W})??[،,]? ?){{1,3}}(?:پلاک|شماره|واحد) ?\d+(?:[،,]? ?(?:واحد|طبقه) ?\d+)?",
        ),
        (
            "pelak|shomare|vahed",
            rf"\b(?:(?:meydane?|khiaboone?|khiabane?|bolvare?|koocheye?|kooche|kuche) {_W}(?: {_W})??,? ?){{1,3}}(?:pelake?|shomareye?|shomare|vahede?) ?\d+(?:,? ?(?:vahede?|tabaghe) ?\d+)?",
        ),
        (
            "رقم|بنایة|مبنی|عمارة|منزل|شقة",
            rf"(?:(?:حی|شارع|میدان|طریق|زقاق|جادة) {_W}(?: {_W})??[،,]? ?){{1,3}}(?:رقم|بنایة|مبنی|عمارة|منزل|شقة) ?\d+(?:[،,]? ?(?:شقة|طابق|الطابق) ?\d+)?",
        ),
    )
)
_HOME_WORDS = re.compile(r"\b(?:live|home|flat|send|parcel|address|vivo|casa|direcci[óo]n|paquete|moro|endere[çc]o|habite|adresse|colis|wohne|wohnung|paket|adres|evim|tinggal|alamat|rumah|khoone|adrese)\b|خانه|آدرس|بیتی|عنوان", re.I)
#: The kinds of street that stand last, as whole words: many texts have their first letters only.
_KIND_LAST = re.compile(r"[ ,](?:street|st|road|rd|lane|ln|avenue|ave|crescent|close|court|ct|drive|dr|boulevard|blvd|terrace|way|place|square|gardens|grove|row|mews)\b", re.I)
_STREET_NUMBER = re.compile(r"\d")

# -- names ------------------------------------------------------------------------------------------

_GIVEN = r"(?P<g>[^\W\d_]{2,}(?:[-'][^\W\d_]+)*)"
_FAMILY = r"(?P<f>[^\W\d_]{2,}(?:[-'][^\W\d_]+)*)"
_FULL = rf"{_GIVEN}(?: [^\W\d_]\.)?(?P<comma>,)? {_FAMILY}"
#: Titles and introductions right before a name, in lower case; what else announces names is learned from the texts.
_TITLES = (
    "dr.|mr.|mrs.|ms.|mr|mrs|miss|prof.|my name is|signed by|yours truly|señora|señor|senora|senor|doña|me llamo|mi nombre es|firmado|dona|senhor|senhora|meu nome é|meu nome e|me chamo|assinado|"
    "mme|mlle|madame|monsieur|je m'appelle|mon nom est|signé|frau|herr|ich heiße|ich heisse|mein name ist|gezeichnet|benim adım|benim adim|sayın|sayin|imza|ibu|bapak|nama saya|tertanda|"
    "khanome|aghaye|esme man|emza|خانم|آقای|اسم من|نام من|امضا|امضاء|السیدة|السید|اسمی|التوقیع|توقیع"
).split("|")
_LEADS = tuple((w, re.compile(rf"(?<![\w#@]){re.escape(w)}:? {_FULL}(?![\w@])", re.I)) for w in _TITLES)
_PIECES = re.compile(r"[^\W\d_]{2,}")
_NAME_WORD = re.compile(r"[^\W\d_]{2,}(?:[-'][^\W\d_]+)*")
#: What may stand between the two words of a name: a blank, an initial, or a comma where the family name comes first.
_BETWEEN = re.compile(r" (?:[^\W\d_]\. )?|, ")
#: Least number of different known names in a context, and least share of known ones among all names it might have.
CONTEXT_NAMES, CONTEXT_SHARE = 3, 0.5
#: Share from which on one word alone announces names whose given name is not known; two words, or words on both sides, do so anyway.
CONTEXT_SURE = 0.6
#: Most contexts that are shipped to the workers.
MAX_CONTEXTS = 50_000
_CAPITALS = re.compile(r"(?<![\w#@'\"«.-])(?P<g>[A-ZÀ-ÞĞİŞÖÜÇ][^\W\d_]+)(?: [A-Z]\.)? (?P<f>[A-ZÀ-ÞĞİŞÖÜÇ][^\W\d_]{3,})(?![\w@])")
_QUOTED = re.compile(r"\"[^\"\n]{1,80}\"|«[^»\n]{1,80}»|(?<!\w)[#@]\w+")


def _is_name(g: str, f: str, comma: bool, given: frozenset, common: frozenset, sure: bool) -> bool:
    """Whether two words (lower case) are a name; ``sure`` if what stands before announces one, so that the given name need not be known."""
    if comma:  # family, given
        return f in given and g not in common or (sure and g not in common and f not in common)
    return f not in common and (g in given or (sure and g not in common))


def _plain_copy(made: str) -> str:
    """A text with ASCII digits, plain spaces and one form of each letter, place for place."""
    return made.replace("\t", " ").replace("\r", " ") if made.isascii() else made.translate(_SAME_LENGTH)


def _all_common(s: str, common: frozenset) -> bool:
    """Whether all words are ordinary ones, outside of quotations, handles and hashtags: such a text has no family name."""
    return common.issuperset(_PIECES.findall(_QUOTED.sub(" ", s).lower()))


def _candidates(s: str, common: frozenset) -> Iterator[tuple[str, str, bool, int, int, tuple, tuple]]:
    """Pairs of words that stand as the parts of a name do: both in lower case, comma, start, end, and their contexts before and after.

    Words in quotations, handles and hashtags are none, and one of the two is no ordinary word. The words before must lead up to the pair with blanks or a colon
    only, those after follow with blanks; a context is one word or two.
    """
    if not s:
        return
    hidden = [q.span() for q in _QUOTED.finditer(s)]
    words = [(m.start(), m.end(), m.group().lower()) for m in _NAME_WORD.finditer(s)]
    h = 0
    for i in range(len(words) - 1):
        a, b, g = words[i]
        c, d, f = words[i + 1]
        if (f in common and g in common) or c - b > 4 or (a and (s[a - 1] in "@#_" or s[a - 1].isalnum())) or (d < len(s) and (s[d] == "@" or s[d].isalnum() or s[d] == "_")):
            continue
        between = s[b:c]
        if between != " " and not _BETWEEN.fullmatch(between):
            continue
        while h < len(hidden) and hidden[h][1] <= a:
            h += 1
        if h < len(hidden) and hidden[h][0] <= a:
            continue
        before = after = ()
        if i and s[words[i - 1][1] : a] in (" ", ": "):
            near = words[i - 1][2]
            before = (f"<{near}",)
            if i > 1 and s[words[i - 2][1] : words[i - 1][0]] == " ":
                before = (f"<{near}", f"<{words[i - 2][2]} {near}")
        if i + 2 < len(words) and s[d : words[i + 2][0]] == " ":
            near = words[i + 2][2]
            after = (f">{near}",)
            if i + 3 < len(words) and s[words[i + 2][1] : words[i + 3][0]] == " ":
                after = (f">{near}", f">{near} {words[i + 3][2]}")
        yield g, f, between == ", ", a, d, before, after


def context_votes(text: str, given: frozenset, common: frozenset) -> list[tuple[str, str | None]]:
    """The contexts ('<' and the words before, '>' and those after) of pairs that could be names, and the given name if it is known."""
    out = []
    s = _plain_copy(_composed(text)[0])
    if _all_common(s, common):
        return out
    for g, f, comma, _, _, before, after in _candidates(s, common):
        first, last = (f, g) if comma else (g, f)
        if last in given or common.issuperset(_PIECES.findall(last)):
            continue
        known = first in given
        if known or first not in common:
            out += [(k, first if known else None) for k in (*before, *after)]
    return out


def _nearest(s: str, start: int, end: int) -> str:
    """What the context word nearest before a number speaks of: identity, phone, other or ''; after it only phones count."""
    before = s[max(0, start - BEFORE) : start]
    digits = [i for i, c in enumerate(before) if c.isdigit()]
    before = before[digits[-1] + 1 :] if digits else before
    best, kind = -1, ""
    for k, p in (("phone", _PHONE_WORDS), ("other", _NOT_PERSONAL), ("identity", _IDENTITY_WORDS)):
        for m in p.finditer(before):
            if m.end() >= best:
                best, kind = m.end(), k
    if kind == "other" and len(before) - best > OTHER_WITHIN:
        kind = ""
    return kind or ("phone" if _PHONE_WORDS.search(s[end : end + AFTER]) else "")


def find(text: str, given: frozenset, common: frozenset, contexts: frozenset = frozenset()) -> list[tuple[int, int, str]]:
    """The accepted spans (start, end, type) of ``text``, in text order and without overlap.

    ``given``: known given names in lower case. ``common``: ordinary words of the
    languages, in lower case; none of them is taken for a family name. ``contexts``: what announces
    or follows names (``name_contexts``).
    """
    if not text:
        return []
    made, places = _composed(text)
    s = _plain_copy(made)
    proposed: list[tuple[float, int, int, int, str]] = []  # negated score, order, start, end, kind

    def add(a: int, b: int, kind: str, score: float) -> None:
        if a < b and score >= ACCEPT:
            proposed.append((-score, len(proposed), a, b, kind))

    hidden: list[tuple[int, int]] | None = None

    def quoted(at: int) -> bool:
        """Whether a place lies in a quotation, a handle or a hashtag."""
        nonlocal hidden
        if hidden is None:
            hidden = [q.span() for q in _QUOTED.finditer(s)]
        i = bisect_left(hidden, (at + 1,))
        return i > 0 and hidden[i - 1][1] > at

    low = s.lower()
    if "@" in s:
        for m in _EMAIL.finditer(s):
            add(m.start(), m.end(), "email", EMAIL_SCORE)
    if any(g in low for g in _AT):
        for m in _EMAIL_SPELT.finditer(s):
            add(m.start(), m.end(), "email", EMAIL_SCORE - 0.1)

    if _STREET_NUMBER.search(s):
        for i, (gates, p) in enumerate(_ADDRESS):
            if any(g in low for g in gates) and (i != 1 or _KIND_LAST.search(s)):
                for m in p.finditer(s):
                    home = bool(_HOME_WORDS.search(s[max(0, m.start() - BEFORE) : m.start()]))
                    add(m.start(), m.end(), "street_address", ADDRESS_SCORE + (0.2 if home else 0.0))

    seven = bool(_SEVEN.search(s))
    tried = {"letter8": bool(_LETTERS_SIX.search(s)), **dict.fromkeys(("nino", "iban"), bool(_THREE_PAIRS.search(s)))}
    if seven or any(tried.values()):
        failed: list[tuple[int, int]] = []
        for name, p, shape, check in _IDENTITY:
            if not tried.get(name, seven):
                continue
            for m in p.finditer(s):
                near = _nearest(s, m.start(), m.end())
                score = shape + {"identity": 0.5, "other": -0.6}.get(near, 0.0)
                passed = bool(check) and check(m.group() if name == "iban" else re.sub(r"[ .\-]", "", m.group()))
                if name in _MUST_PASS and not passed:
                    failed.append(m.span())  # nor is a part of it a number of another kind
                    continue
                if passed:
                    score += _CONFIRMED.get(name, 0.1)
                if name == "nir" and m.group().count(" ") >= 5:
                    score += 0.3
                add(m.start(), m.end(), "identity_number", score)
        for p, shape in _PHONES if seven else ():
            for m in p.finditer(s):
                if any(a <= m.start() and m.end() <= b for a, b in failed):
                    continue
                near = _nearest(s, m.start(), m.end())
                score = shape + {"phone": 0.35, "identity": -0.6, "other": -0.6}.get(near, 0.0) + (0.3 if m.group()[:3].lower() == "tel" else 0.0)
                if score >= ACCEPT and 7 <= sum(c.isdigit() for c in m.group()) <= 15:
                    add(m.start() + (m.group()[0] == "(" and ")" not in m.group()), m.end(), "phone", score)

    for lead, pattern in _LEADS:
        if lead in low:
            for m in pattern.finditer(s):
                if _is_name(m["g"].lower(), m["f"].lower(), bool(m["comma"]), given, common, True):
                    add(m.start("g"), m.end("f"), "person_name", NAME_SCORE + 0.1)
    if contexts and not _all_common(s, common):
        for g, f, comma, start, end, before, after in _candidates(s, common):
            left, right = not contexts.isdisjoint(before), not contexts.isdisjoint(after)
            sure = left and (right or any(f"!{k}" in contexts or (" " in k and k in contexts) for k in before))
            # words that follow a name follow much else: alone they need a known given name
            if (left or right) and not common.issuperset(_PIECES.findall(g if comma else f)) and _is_name(g, f, comma, given, common, sure):
                # what is known of the name and each side of it that announces one add to the score
                add(start, end, "person_name", NAME_SCORE + 0.1 * (left + right) + (0.1 if g in given or (comma and f in given) else 0.0) - 0.05)
    for m in _CAPITALS.finditer(s):
        if m["g"].lower() in given and m["f"].lower() not in common and not quoted(m.start()):
            add(m.start(), m.end(), "person_name", NAME_SCORE)

    spans: list[tuple[int, int, str]] = []
    for _, _, start, end, kind in sorted(proposed):
        i = bisect_left(spans, (start,))  # the spans are kept in order and apart, so only two of them can meet it
        if not ((i < len(spans) and spans[i][0] < end) or (i > 0 and spans[i - 1][1] > start)):
            insort(spans, (start, end, kind))
    if places:
        spans = [(places[a], places[b], k) for a, b, k in spans]
    return sorted(spans)


def redact(text: str, spans: Iterable[tuple[int, int, str]]) -> str:
    """``text`` with each span replaced by its type in square brackets."""
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def knowledge(names: DataFrame, samples: DataFrame) -> tuple[frozenset, frozenset]:
    """Given names and ordinary words, from two small tables whose sizes are checked first.

    A sample word counts as ordinary if it is no handle, hashtag or part of a quoted title.
    """
    given = names.select(F.lower("given_name").alias("n")).where("n is not null").distinct().limit(MAX_NAMES + 1).toPandas()["n"]
    texts = samples.select("text").where("text is not null").limit(MAX_SAMPLES + 1).toPandas()["text"]
    if len(given) > MAX_NAMES or len(texts) > MAX_SAMPLES:
        raise ValueError("the tables of names and samples are too large to be shipped to every worker")
    common: set[str] = set()
    for t in texts:
        clean = _QUOTED.sub(" ", unicodedata.normalize("NFC", t).translate(_SAME_LENGTH))
        common |= {w.lower() for w in re.findall(r"[^\W\d_]+", clean)}
    small = frozenset(unicodedata.normalize("NFC", n).translate(_SAME_LENGTH) for n in given)
    return small, frozenset(common)


def name_contexts(texts: DataFrame, text: str, given: frozenset, common: frozenset) -> frozenset:
    """What stands before or after names, learned from known given names in all texts.

    A context counts if ``CONTEXT_NAMES`` different known given names or more stand in it, and pairs with a known one are at least
    ``CONTEXT_SHARE`` of the pairs in it that could be names. A sentence in which an ordinary word happens to be a name
    has only that one, however often it is copied. Contexts with a share of ``CONTEXT_SURE`` come out a second time with '!' before them. Counts are combined on the map side; what comes to the
    driver are contexts with that support, whose number is checked.
    """
    shipped = ship(texts.sparkSession).sparkContext.broadcast((given, common))

    @F.arrow_udf("array<struct<context:string,name:string>>")
    def votes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        g, c = shipped.value
        for batch in batches:
            yield pa.array([[{"context": k, "name": n} for k, n in context_votes(t, g, c)] if t else [] for t in batch.to_pylist()], pa.list_(pa.struct([("context", pa.string()), ("name", pa.string())])))

    vote = texts.select(F.explode(votes(F.col(text))).alias("v")).select("v.*")
    named = vote.groupBy("context", "name").agg(F.count(F.lit(1)).alias("n"))
    counted = named.groupBy("context").agg(F.count("name").alias("names"), F.sum(F.when(F.col("name").isNotNull(), F.col("n")).otherwise(0)).alias("known"), F.sum("n").alias("pairs"))
    kept = counted.where((F.col("names") >= CONTEXT_NAMES) & (F.col("known") >= CONTEXT_SHARE * F.col("pairs"))).select("context", (F.col("known") >= CONTEXT_SURE * F.col("pairs")).alias("sure")).limit(MAX_CONTEXTS + 1).toPandas()
    if len(kept) > MAX_CONTEXTS:
        raise ValueError(f"more than {MAX_CONTEXTS} contexts of names")
    return frozenset(kept["context"]) | frozenset(f"!{k}" for k in kept["context"][kept["sure"].astype(bool)])


def scan(df: DataFrame, names: DataFrame, samples: DataFrame, text: str, redacted: bool = False) -> DataFrame:
    """``df`` with ``kinds`` (array of the types found) or, with ``redacted``, ``clean_text`` and ``spans`` (how many).

    Two passes over the texts: the first learns what announces names, the second finds and replaces.
    NULL texts have no kinds and stay NULL; empty texts stay empty. Rows are
    neither moved nor merged; columns of ``df`` stay, save those with the names of the made ones.
    """
    given, common = knowledge(names, samples)
    contexts = name_contexts(df, text, given, common)
    spark: SparkSession = ship(df.sparkSession)
    shipped = spark.sparkContext.broadcast((given, common, contexts))

    if not redacted:

        @F.pandas_udf("array<string>")
        def kinds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series([sorted({k for _, _, k in find(t, *shipped.value)}) if t else [] for t in batch], dtype=object)

        # as non-deterministic it is not evaluated once more for a filter on its result
        return df.withColumn("kinds", kinds.asNondeterministic()(F.col(text)))

    @F.pandas_udf("clean_text string, spans int")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(t, find(t, *shipped.value) if t else []) for t in batch]
            yield pd.DataFrame({"clean_text": [redact(t, f) if t else t for t, f in found], "spans": [len(f) for _, f in found]})

    made = carry(df, _text=text).withColumn("_clean", clean.asNondeterministic()(F.col("_text"))).select("_row", "_clean.*")
    return restore(made, df, "clean_text", "spans")


def both_sources(events: DataFrame, records: DataFrame) -> DataFrame:
    """The rows of both text tables: source_table, row_id, text."""
    return events.select(F.lit("graph_events").alias("source_table"), F.col("event_id").alias("row_id"), F.col("cleaned_text").alias("text")).unionAll(
        records.select(F.lit("normalized_records").alias("source_table"), F.col("record_id").alias("row_id"), F.col("text_raw").alias("text"))
    )


def found(events: DataFrame, records: DataFrame, names: DataFrame, samples: DataFrame) -> DataFrame:
    """One row per row of either table and kind of personal datum in it."""
    rows = scan(both_sources(events, records), names, samples, "text")
    return rows.select("source_table", "row_id", F.explode("kinds").alias("pii_type"))
