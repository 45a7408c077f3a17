import pytest

from tidegraph.llm import pii

GIVEN = frozenset({"clara", "grace", "hope", "rose", "sol", "umut", "andrés", "باران", "رضا", "سلمی", "bernd", "jasper"})
COMMON = frozenset("the we hope tour has and petals told us to leave at desk vivo aquí salió".split())

#: What texts teach about names here.
CONTEXTS = frozenset({"<ask for", "!<ask for", "<falem com", "!<falem com", ">na entrada", ">at the"})

FOUND = [
    ("mail a.b+c@sub.example.org now", "email", "a.b+c@sub.example.org"),
    ("x my correo es bot.guy @ example.net mis", "email", "bot.guy @ example.net"),
    ("at ran.rip [at] letters [dot] invalid ok", "email", "ran.rip [at] letters [dot] invalid"),
    ("write me at tam.das at letters dot invalid", "email", "tam.das at letters dot invalid"),
    ("تماس top＠fanbox.test.", "email", "top＠fanbox.test"),
    ("call me on +1 617-555-0110.", "phone", "+1 617-555-0110"),
    ("(312) 555-0116", "phone", "(312) 555-0116"),
    ("پیام بدهید ۰۰۹۸۲۱۰۰۰۰۷۳۱۱ ok", "phone", "۰۰۹۸۲۱۰۰۰۰۷۳۱۱"),
    ("mi número es +44 7700 900 343 345678 votos", "phone", "+44 7700 900 343"),
    ("meine Nummer ist 030/23125-856", "phone", "030/23125-856"),
    ("SSN 987-26-2576", "identity_number", "987-26-2576"),
    ("the ticket queue, ID card number 0072958400", "identity_number", "0072958400"),
    ("شماره ملی من ۰۰۳۴۵۶۲۰۲۳ است", "identity_number", "۰۰۳۴۵۶۲۰۲۳"),
    ("national insurance QQ 13 32 67 C", "identity_number", "QQ 13 32 67 C"),
    ("n° de sécurité sociale 9 90 13 00 576 627 39", "identity_number", "9 90 13 00 576 627 39"),
    ("the meeting is at my flat, 149b Lanepar crescent", "street_address", "149b Lanepar crescent"),
    ("envoyez le colis au 52 bis, avenue Mukazitas", "street_address", "52 bis, avenue Mukazitas"),
    ("manden el paquete a calle Bavelgem, 99, 3º B", "street_address", "calle Bavelgem, 99, 3º B"),
    ("خانه ما بلوار رابوسیتو پلاک ۱۴۴ واحد ۳ است", "street_address", "بلوار رابوسیتو پلاک ۱۴۴ واحد ۳"),
    ("saya tinggal di Gang Tapatil nomor 25", "street_address", "Gang Tapatil nomor 25"),
    ("Ask for MARCUS ZERUDRETH at the desk", "person_name", "MARCUS ZERUDRETH"),
    ("signed by Wendeline Vamoko.", "person_name", "Wendeline Vamoko"),
    ("اسم من هورناز نوسورشالینرن است", "person_name", "هورناز نوسورشالینرن"),
    ("falem com Nolriklar, Clara na entrada", "person_name", "Nolriklar, Clara"),
    ("Clara S. Gajofiri was there", "person_name", "Clara S. Gajofiri"),
]
NOTHING = [
    "meet @ 7.30 by gate 17", "user@ is not a name", "status 1552293370965167893 is pinned", "ticket serial 1619584940 was mine", "it was 3-2 after 486 minutes", "updated 2021-03-13", "order no 8987801313 shipped", "street team 68 waits at dawn", "we hope the tour has Grace and Rose petals",
    "Jasper told us to leave", "me llamo Andrés K", "el sol salió a dos calles de aquí", "123456 votes", "#Clara #Gajofiri @clara_gajofiri", 'the song "Clara Gajofiri"', "chart 202.5 to 555.6", "", " ", "شماره بلیت 4141731361 بود", "passport 4111 1111 1111 1112", "IBAN DE89 3704 0044 0532 0130 01",
]


@pytest.mark.parametrize("text, kind, span", FOUND)
def test_found(text, kind, span):
    assert (kind, span) in {(k, text[a:b]) for a, b, k in pii.find(text, GIVEN, COMMON, CONTEXTS)}


@pytest.mark.parametrize("text", NOTHING)
def test_nothing(text):
    assert pii.find(text, GIVEN, COMMON, CONTEXTS) == []


def test_checksums():
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")
    assert pii.mod97("DE89 3704 0044 0532 0130 00") and not pii.mod97("DE88370400440532013000")
    assert pii.national_ten("0084575948") and not pii.national_ten("0084575949")
    assert pii.national_eleven("10000000146") and not pii.national_eleven("10000000147")
    assert pii.two_checks("52998224725") and not pii.two_checks("52998224726") and pii.check_letter("12345678Z")


def test_more_checks():
    assert pii.nir_key("255081416802538") and not pii.nir_key("255081416802539") and not pii.nir_key("2550814168025") and pii.nir_key("2550820168025" + f"{97 - int('2550820168025') % 97:02d}")
    assert pii.tax_eleven("86095742719") and not pii.tax_eleven("86095742718")
    assert pii.social_area("219099999") and not pii.social_area("900123456") and pii.insurance_prefix("AB123456C") and not pii.insurance_prefix("QQ123456C")


def test_the_higher_score_stands():
    """A name inside of an address gives way to it, a number of several shapes is one span."""
    found = pii.find("I live at 12 Clara Hopeson street, call +1 617-555-0110", GIVEN, COMMON)
    assert [k for _, _, k in found] == ["street_address", "phone"]
    assert [k for _, _, k in pii.find("card 4111 1111 1111 1111 ok", GIVEN, COMMON)] == ["identity_number"]


def test_contexts_of_names_are_learned(spark):
    """Different known names in one place of a sentence teach what stands around them; one name in a copied sentence does not."""
    given, common = frozenset({"clara", "bernd", "jasper", "hope"}), frozenset("we met the at gate and it was late summer".split())
    texts = [f"{g} Zorvel{x} met us and later we found {g} Marn{x} waiting quietly" for g, x in (("Clara", "a"), ("Bernd", "b"), ("Jasper", "c"))]
    texts += ["and hope blossom today"] * 50 + ["our song found Ulmar Vendik somewhere"] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = pii.name_contexts(df, "t", given, common)
    assert "<we found" in got and ">waiting quietly" in got and not any("blossom" in k or "today" in k or k == "<and" for k in got)
    assert [k for _, _, k in pii.find("later we found Ulmar Vendik waiting quietly", given, common, got)] == ["person_name"]
    assert pii.find("later we found Ulmar Vendik waiting quietly", given, common) == []
    assert pii.find("we found #Ulmar Vendik and \"Ulmar Vendik\"", given, common, got) == []
    assert pii.name_contexts(df.limit(0), "t", given, common) == frozenset()


def test_rest_of_the_text_stays(spark):
    rows = [(1, "é mail a@b.example ١٢ 🌙\n@x #y"), (2, None), (3, ""), (4, "no data"), (5, "z" * 200_000 + " a@b.example")]
    df = spark.createDataFrame([(i, t, "mine", 9) for i, t in rows], "id int, t string, clean_text string, _clean int")
    names, samples = spark.createDataFrame([("Clara",), (None,)], "given_name string"), spark.createDataFrame([("the tour",), (None,)], "text string")
    got = {r.id: r for r in pii.scan(df, names, samples, "t", redacted=True).collect()}
    assert got[1].clean_text == "é mail [EMAIL] ١٢ 🌙\n@x #y" and got[1].spans == 1 and got[1]._clean == 9
    assert got[2].clean_text is None and got[3].clean_text == "" and got[4].clean_text == "no data" and got[4].spans == 0
    assert got[5].clean_text.endswith("z [EMAIL]")
    assert [r.kinds for r in pii.scan(df, names, samples, "t").orderBy("id").collect()] == [["email"], [], [], [], ["email"]]
    assert pii.scan(df.limit(0), names, samples, "t").count() == 0


@pytest.mark.parametrize("text", ["z" * 300_000, "9" * 300_000, "a.b" * 100_000, "- " * 100_000, "Clara " * 50_000, "+1 " * 60_000, "x" + " " * 200_000 + "y", "@" * 200_000, "calle " * 30_000 + "7"])
def test_long_runs_take_linear_time(text):
    import time

    began = time.process_time()
    pii.find(text, GIVEN, COMMON)
    assert time.process_time() - began < 20
