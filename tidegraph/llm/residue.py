"""Template residue, filler, error pages and script notices among documents (problem 10).

What decides, in this order:

* slots: places that a template meant to fill, found outside quotations and code;
* filler: one short phrase over and over;
* duplicated low-information text: words that ordinary texts of the languages do not have, but
  several different short texts on several hosts do, mark messages; a text that
  consists of them is one ('repeated'). A title or an address slug of which no term occurs in
  the body needs fewer of them;
* support: the texts found so far, and a small table of known phrases, say how often each term stands in
  messages, and the texts of ordinary words how often it stands in content. A text whose terms nearly
  all stand in messages, and rather there than in content, is one too ('message').

What marks messages is counted over different texts, so a post copied many times weighs no more than once. Texts
that talk about messages have many words that no message has, which keeps them. Content texts, whose terms speak against
messages, have more than a few ordinary terms and no fewer than foreign ones.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.frames import restore
from tidegraph.session import written

#: Phrases that messages, notices and filler commonly have (a parameter of ``flagged``): they support what the
#: counts find, and stand in for them where texts are few.
PHRASES = """page not found|internal server error|bad gateway|service unavailable|gateway timeout|access denied|forbidden|unauthorized|too many requests|rate limit reached|rate limit exceeded|request timed out|the connection timed out|
something went wrong please try again|an unexpected error occurred|unexpected error|your session has expired please log in again|this page does not exist|this content is not available|down for maintenance|error http status code|error message code|
errors message code reference|oops sorry|please enable javascript to continue|javascript is disabled in your browser|this app needs javascript|your browser does not support scripts|scripts are blocked turn on javascript|noscript|
lorem ipsum dolor sit amet consectetur adipiscing elit|placeholder text|dummy text|sample text|text goes here|test test|xxx xxx|
página no encontrada|acceso denegado|error del servidor|algo salió mal inténtelo de nuevo|active javascript|su navegador bloquea los scripts|texto de ejemplo|escriba aquí su texto|
página não encontrada|esta página sumiu|acesso negado|erro do servidor|algo deu errado tente novamente|ative o javascript|seu navegador bloqueia scripts|texto de exemplo|escreva aqui o seu texto|
page introuvable|accès refusé|erreur du serveur|une erreur est survenue rechargez la page|activez javascript|votre navigateur bloque les scripts|texte d exemple|saisissez votre texte ici|
seite nicht gefunden|diese seite gibt es nicht|zugriff verweigert|serverfehler|da ging etwas schief bitte neu laden|bitte javascript einschalten|ihr browser sperrt skripte|blindtext|hier steht später der text|
sayfa bulunamadı|erişim engellendi|sunucu hatası|bir şeyler ters gitti yeniden deneyin|javascript i açın|tarayıcınız betikleri engelliyor|örnek metin|metni buraya yazın|
halaman tidak ditemukan|halaman tidak ada|akses ditolak|galat server|ada yang salah coba lagi|nyalakan javascript|peramban anda memblokir skrip|contoh teks|tulis teks di sini|
صفحه پیدا نشد|دسترسی مجاز نیست|سرور پاسخ نمی دهد|مشکلی پیش آمد دوباره تلاش کنید|جاوااسکریپت را روشن کنید|مرورگر شما اسکریپت را بسته است|متن نمونه|متن را اینجا بنویسید|
الصفحة غير موجودة|الوصول مرفوض|الخادم لا يستجيب|حدث خلل أعد المحاولة|فعّل جافا سكريبت|متصفحك يحجب البرامج النصية|نص تجريبي|اكتب النص هنا"""

#: Ordinary terms a text may have and still be one of little information.
LOW_INFORMATION = 6
#: Least share of message terms, among those and ordinary ones, of a repeated text; the second where title or address do not fit the body.
SHARE, SHARE_MISMATCH = 0.6, 0.5
#: Least share of a text's terms that messages must have: with a balance towards messages, and with half of its terms repeated.
COVERED, COVERED_HALF = 0.75, 0.9
#: What is known of content before any text is read: so many texts, and the share of them an ordinary term stands in.
PRIOR_TEXTS, PRIOR_RATE = 1_000, 0.02
#: Filler: at most so many different terms, each standing so often on average.
FILLER_TERMS, FILLER_TIMES = 8, 3
#: Most words of ordinary texts, and most sample texts they are taken from.
MAX_ORDINARY, MAX_SAMPLES = 200_000, 50_000

#: Letters that fold to another one without being composed of it and a mark (fixed values).
_ALIKE = {"ı": "i", "ø": "o", "đ": "d", "ł": "l", "ي": "ی", "ى": "ی", "ك": "ک", "ة": "ه"}


def _folds() -> dict[str, str]:
    """Composed Latin and Arabic letters and the bare letter of each, in one step."""
    out = dict(_ALIKE)
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0x620, 0x6D4)]):
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if c.lower() == c and len(bare) == 1 and bare != c:
            out[c] = _ALIKE.get(bare, bare)
    return out


_FOLDS = _folds()


def _fold_text(s: str) -> str:
    s = "".join(_FOLDS.get(c, c) for c in s.lower())
    return "".join(c for c in s if unicodedata.category(c) != "Mn")


def fold(c: Column) -> Column:
    """Lower case without accents and vowel signs, letter variants unified."""
    return F.regexp_replace(F.translate(F.lower(c), "".join(_FOLDS), "".join(_FOLDS.values())), r"\p{Mn}", "")


_NUMBERS = r" (?:[0-9]+[a-z]?|[0-9a-f]{8,})(?= )"
#: Longest quotation or piece of code in which a slot is only talked about (characters).
MAX_QUOTE = 120
_TALK = rf"`[^`\n]{{1,{MAX_QUOTE}}}`|\"[^\"\n]{{1,{MAX_QUOTE}}}\"|“[^”\n]{{1,{MAX_QUOTE}}}”"
_STAGE = "laughs?|laughing|whispers?|whispering|sighs?|claps?|clapping|applause|verse|chorus|bridge|intro|outro|hook|refrain|instrumental|cries|crying|screams?|music|silence|pause|cheers"
_ASKS = (
    "your|insert|tbd|tbc|todo|name|username|user|date|here|venue|city|link|title|hashtag|handle|enter|nombre|fecha|ingrese|inserte|nome|data|insira|nom|pr[ée]nom|votre|ins[ée]rez|ihr|vorname|datum|einf[üu]gen|"
    "ad[ıi]n[ıi]z|isim|tarih|kullan[ıi]c[ıi]|nama|anda|tanggal|isi|seu|sua|نام|تاریخ|کاربر|وارد|اسم|المستخدم|التاريخ|أدخل|ادخل"
)
#: Characters that may stand before and after an asking word in single brackets; a longer bracket is a remark.
ASK_ROOM = 24
SLOT = "|".join(
    (
        r"\{\{[^{}\n]++\}\}",
        r"\{%[^%\n]++%\}",
        r"<%[^%\n]++%>",
        r"[$#]\{[\p{L}_][^{}\n]*+\}",
        r"\[\[[\p{L}_][^\]\[\n]*+\]\]",
        r"<<[\p{L}_]+>>",
        r"@@[\p{L}_]+@@",
        r"\*\|[\p{L}_:]+\|\*",
        r"%%?[A-Z_]{3,}%%?",
        r"%\([\p{L}_]+\)[sd]",
        r"__[A-Z][A-Z_]+__",
        r"\bXX_\w+_XX\b",
        r"\$[\p{L}]+(?:_[\p{L}_]+)?\$",
        r"\{[0-9]{1,2}\}",
        rf"\{{(?!(?i:{_STAGE})\}})[\p{{L}}][\p{{L}}_.]*\}}",
        rf"\[(?iu:[^\]\[\n]{{0,{ASK_ROOM}}}(?<![\p{{L}}])(?:{_ASKS})(?![\p{{L}}])[^\]\[\n]{{0,{ASK_ROOM}}})\]",
        r"<[a-z]+_[a-z_]+>|<(?i:name|handle|user|username|first ?name|date|city|title|email|link|venue|artist|seat|nombre|nome|nom)>",
        r"&lt;[\p{L}_ ]{2,}+&gt;",
        rf"«(?iu:[^»\n]{{0,{ASK_ROOM}}}(?:وارد کنید|را بنویسید|أدخل|ادخل|insert |enter |ingrese |insira |saisissez |einfügen|giriniz|masukkan )[^»\n]{{0,{ASK_ROOM}}})»",
    )
)
#: What every slot begins with; the full patterns are tried only on texts that have it. No slot lies outside it.
_SLOT_MARK = r"[{}\[<«]|@@|__|\*\||XX_|%[A-Z_(]|\$[\p{L}{]|&lt;"


def ordinary_words(samples: DataFrame, most: int = MAX_SAMPLES) -> frozenset:
    """The folded words of a small table of sample texts, whose size is checked first."""
    texts = samples.select("text").where("text is not null").limit(most + 1).collect()
    if len(texts) > most:
        raise ValueError(f"more than {most} sample texts")
    found = frozenset(w for r in texts for w in re.findall(r"[^\W_]+", _fold_text(r.text)))
    if len(found) > MAX_ORDINARY:
        raise ValueError(f"more than {MAX_ORDINARY} ordinary words")
    return found


def _words(c: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "), " "), "")


def evidence(df: DataFrame, text: str, address: str | None = None, ordinary: Iterable[str] = ()) -> DataFrame:
    """``df`` with ``slots``, ``words``, ``terms``, ``foreign``, ``mismatch`` and ``signature``.

    ``terms`` are a text's distinct words other than numbers and hexadecimal ids, ``words`` how many words
    they are, ``foreign`` the terms that are not among ``ordinary`` words. ``mismatch``: no term of the title (first
    line) or of the address slug occurs in the body of a text of little information. ``signature``: hash of the words in order, equal for
    texts that differ in numbers, ids and punctuation only. NULL texts count as empty.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    known = sorted(ordinary)
    bare, spaced = F.col("_bare"), F.col("_spaced")
    start = F.ltrim(bare)
    title, cut = _words(F.substring_index(start, "\n", 1)), F.locate("\n", start)
    apart = (cut > 0) & (F.size(title) > 0) & F.coalesce(~F.arrays_overlap(title, _words(F.substr(start, cut + 1))), F.lit(False))
    if address:
        slug = _words(fold(F.regexp_extract(F.coalesce(F.col(address), F.lit("")), r"([^/?#]*)/?(?:[?#].*)?$", 1)))
        apart = apart | ((F.size(slug) > 0) & F.coalesce(~F.arrays_overlap(slug, F.split(F.trim(spaced), " ")), F.lit(False)))
    return (
        df.withColumn("_bare", F.regexp_replace(fold(whole), r"</?[a-z][a-z0-9]*>", " "))
        .withColumn("_spaced", F.concat(F.lit(" "), F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " "), F.lit(" ")))
        .withColumn("_masked", F.trim(F.regexp_replace(spaced, _NUMBERS, "")))
        .withColumn("_split", F.array_remove(F.split("_masked", " +"), ""))
        .withColumn("terms", F.array_distinct("_split"))
        .withColumn("foreign", F.filter("terms", lambda t: ~t.isin(known)) if known else F.col("terms"))
        .withColumns(
            {
                "words": F.size("_split"),
                "slots": F.when(whole.rlike(_SLOT_MARK), F.regexp_count(F.regexp_replace(whole, _TALK, " "), F.lit(SLOT))).otherwise(0),
                "mismatch": F.when(F.size("terms") - F.size("foreign") <= LOW_INFORMATION, apart).otherwise(False),
                "signature": F.xxhash64("_masked"),
            }
        )
        .drop("_bare", "_spaced", "_masked", "_split")
    )


def _vocabulary(phrases: str, df: DataFrame) -> DataFrame:
    """The terms of a table of phrases: term and, in how many phrases it stands, ``known``."""
    lists = [sorted(set(re.findall(r"[^\W_]+", _fold_text(p)))) for p in phrases.split("|")]
    rows = [(t, 1) for terms in lists for t in terms]
    return df.sparkSession.createDataFrame(rows, "term string, one int").groupBy("term").agg(F.sum("one").alias("known"))


def message_texts(texts: DataFrame, repeats: int = 3, phrases: str = PHRASES) -> DataFrame:
    """The signatures of texts that are messages: signature and reason ('repeated' or 'message').

    ``texts``: signature, host, terms, foreign and mismatch of each text. A term marks messages if it is
    foreign and stands in ``repeats`` different texts of little information or more, over two hosts or more.
    Only texts of little information and the few near to messages are moved; of all others terms are counted
    where they are read. No task holds the texts of a term or of a host.
    """
    ordinary = F.size("terms") - F.size("foreign")
    one = [F.any_value("terms").alias("terms"), F.any_value("foreign").alias("foreign"), F.max("mismatch").alias("mismatch")]
    low = texts.where((F.size("terms") > 0) & (ordinary <= LOW_INFORMATION))
    low = low.groupBy("signature", "host").agg(*one).groupBy("signature").agg(*one, F.min("host").alias("first_host"), F.max("host").alias("last_host"))
    low = written(low.withColumn("ordinary", ordinary), "low")
    marks = (
        low.select(F.explode("foreign").alias("term"), "first_host", "last_host")
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("texts"), F.min("first_host").alias("a"), F.max("last_host").alias("b"))
        .where((F.col("texts") >= repeats) & (F.col("a") < F.col("b")))
        .select("term")
    )
    marks = written(marks, "marks")
    share = F.try_divide(F.col("marked"), F.col("marked") + F.col("ordinary"))

    def with_share(df: DataFrame) -> DataFrame:
        marked = df.select("signature", F.explode("foreign").alias("term")).join(marks, "term").groupBy("signature").agg(F.count(F.lit(1)).alias("marked"))
        return df.join(marked, "signature", "left").fillna(0, ["marked"]).withColumn("share", F.coalesce(share, F.lit(0.0)))

    seed = (F.col("marked") > 0) & (F.col("share") >= F.when(F.col("mismatch"), SHARE_MISMATCH).otherwise(SHARE))
    seeds = written(with_share(low).where(seed).select("signature", "terms"), "seeds")
    held = seeds.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("known"))
    support = held.unionByName(_vocabulary(phrases, texts)).groupBy("term").agg(F.sum("known").alias("known")) if phrases else held
    support = written(support, "support")

    # sums over the texts of one signature: the share of terms is that of each
    met = texts.select("signature", F.explode("terms").alias("term")).join(support.select("term", F.lit(1).alias("held")), "term", "left")
    covered = met.groupBy("signature").agg(F.count(F.lit(1)).alias("all_terms"), F.count("held").alias("held_terms")).where(F.col("held_terms") >= COVERED * F.col("all_terms"))
    covered = covered.join(seeds, "signature", "left_anti").select("signature", F.try_divide("held_terms", "all_terms").alias("covered"))
    near = texts.join(covered, "signature").groupBy("signature").agg(*one, F.any_value("covered").alias("covered"))
    near = written(with_share(near.withColumn("ordinary", ordinary)), "near")

    # how often the terms of what is left stand in content
    content = texts.where((ordinary > LOW_INFORMATION) & (ordinary >= F.size("foreign")))
    asked = near.select(F.explode("terms").alias("term")).distinct()
    against = content.select(F.explode("terms").alias("term")).join(asked, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("plain"))
    n_seeds, n_content = seeds.count() + (len(phrases.split("|")) if phrases else 0), content.count()
    k, p = F.coalesce("known", F.lit(0)), F.coalesce("plain", F.lit(0)) + F.when(F.col("strange"), 0.0).otherwise(PRIOR_TEXTS * PRIOR_RATE)
    odds = F.when((k > 0) | (p > 0), F.ln((k + 0.5) / (n_seeds + 1.0)) - F.ln((p + 0.5) / (n_content + PRIOR_TEXTS + 1.0))).otherwise(0.0)
    of_text = F.explode(F.transform("terms", lambda t: F.struct(t.alias("term"), F.array_contains("foreign", t).alias("strange")))).alias("t")
    balance = near.select("signature", of_text).select("signature", "t.*").join(support, "term", "left").join(against, "term", "left").groupBy("signature").agg(F.avg(odds).alias("balance"))
    enough = (F.col("balance") >= 0) | ((F.col("covered") >= COVERED_HALF) & (F.col("share") >= 0.5))
    messages = near.join(balance, "signature").where(enough).select("signature", F.lit("message").alias("reason"))
    return seeds.select("signature", F.lit("repeated").alias("reason")).unionByName(messages)


def flagged(
    df: DataFrame, text: str, host: str, address: str | None = None, repeats: int = 3, ordinary: Iterable[str] = (), columns: list[str] | None = None, phrases: str = PHRASES
) -> DataFrame:
    """``columns`` of ``df`` (all of them by default) with ``reason``: 'slot', 'filler', 'repeated', 'message' or NULL (content).

    Blank texts and NULL are content of length zero: they have no reason. Missing hosts count as one host,
    hosts are compared without case and with any of blank, '-' and '_' alike. ``ordinary``: words of ordinary texts;
    without them every word is foreign. ``phrases``: known phrases, separated by bars; '' for none. A column
    named reason is replaced.
    """
    needed = {"_text": F.col(text).cast("string"), "_from": F.coalesce(F.regexp_replace(F.lower(F.trim(F.col(host).cast("string"))), r"[\s_-]+", "_"), F.lit(""))}
    if address:
        needed["_address"] = F.col(address).cast("string")
    kept = df.select(*[F.col(f"`{c}`") for c in (columns or df.columns)])
    row = F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("_row")
    e = evidence(df.select(row, *[c.alias(name) for name, c in needed.items()]), "_text", "_address" if address else None, ordinary)
    different = F.size("terms")
    filler = (different > 0) & (different <= FILLER_TERMS) & (F.col("words") >= FILLER_TIMES * different) & (different > 1)
    first = F.when(F.col("slots") > 0, "slot").when(filler, "filler")
    # the evidence is used twice, so it is written once
    decided = written(e.select("_row", "_from", "signature", "terms", "foreign", "mismatch", first.alias("_first")), "residue")
    # texts with slots are none to learn messages from
    texts = decided.where("_first is null or _first = 'filler'").select("signature", F.col("_from").alias("host"), "terms", "foreign", "mismatch")
    found = message_texts(texts, repeats, phrases)
    # the found ones are few; the documents stay where they are as long as Spark may broadcast them
    return restore(decided.select("_row", "signature", "_first").join(found, "signature", "left").select("_row", F.coalesce("_first", "reason").alias("reason")), kept, "reason")
