import pytest

from tidegraph.llm import residue

LONG = "x" * 200
SLOTS = [
    "Hi <first_name>, thanks for joining. We saved the song.", "سلام [نام کاربر]، به جمع ما", "Oi {nome}, obrigada", "See you on {0} by the gate", "وعده ما «تاریخ را وارد کنید» کنار در", "&lt;handle&gt; günü görüşürüz", "on XX_DATE_XX we meet",
    f"Dear {{{{{LONG}}}}}, welcome", f"We meet at ${{{LONG}}}", f"In [[{LONG}]] again", f"At {{% {LONG} %}}", f"Hi &lt;{LONG}&gt;",
]
FILLER = ["text goes here\ntext goes here\ntext goes here", "contoh teks contoh teks contoh teks", "metni buraya yazın. metni buraya yazın. metni buraya yazın"]
MESSAGES = ["lorem ipsum dolor sit amet consectetur adipiscing elit", "Error 404: no page found / 90dc10d8bf34", '{"errors": [{"message": "Accès refusé", "code": 245}]}', "دسترسی مجاز نیست - ef668cc17b7b", "Something went wrong, please try again", "Bitte JavaScript einschalten"]
FLAGGED = [*((t, "slot") for t in SLOTS), *((t, "filler") for t in FILLER), *((t, "message") for t in MESSAGES)]
ORDINARY = "i in the my but was of we to our at on it and so would then that until with".split()
CONTENT = [
    "Use `${title}` in your caption tool if you want the song name filled in.", 'The form letter read "Dear {{first_name}}" and the whole chat laughed for an hour.', "The lyric card had {laughs} and [whispers] written in the margin.", "[Verse 2] we hum along [Chorus] we shout it",
    "My little script is if (votes > 10) { print(votes) } and it runs.", 'The counts were {"likes": 12, "views": 340} in the export.', "The hall was <3 and the lights > everything, 100% sure.", "I got an internal server error in the middle of the queue but my seat was kept.",
    "Someone asked me how to enable JavaScript on the old laptop so the voting page would load, and it worked.", "Access was denied at gate 3 until they checked our lists again.", "", None, " \n", "Menu Home", "x" * 150_000,
]


@pytest.fixture(scope="module")
def flags(spark):
    rows = [(i, t, f"host{i % 2}", "mine", 5) for i, t in enumerate([t for t, _ in FLAGGED] + CONTENT * 4)]
    df = spark.createDataFrame(rows, "id int, text string, host string, signature string, words int")
    return {r.id: r for r in residue.flagged(df, "text", "host", ordinary=ORDINARY).collect()}


def test_flagged(flags):
    for i, (text, reason) in enumerate(FLAGGED):
        assert flags[i].reason == reason, text


def test_content_stays_even_repeated(flags):
    for i in range(len(FLAGGED), len(FLAGGED) + 4 * len(CONTENT)):
        assert flags[i].reason is None, flags[i].text
    assert {r.signature for r in flags.values()} == {"mine"} and {r.words for r in flags.values()} == {5}


def test_repeated_over_hosts(spark):
    """Without any known phrase: what different short texts on several hosts share, and ordinary ones lack, is a message."""
    frames = ["Upstream session blocked, gateway offline", "<h1>Upstream session blocked, gateway offline</h1> node 7a", "Home Menu Upstream session blocked, gateway offline", "Upstream session blocked", "Gateway offline Menu Home"]
    posts = [f"we kept our seats at the gate {w} and it was in the rain" for w in ("zavo", "mirel", "tosk", "pelu", "ranno", "vidd")]
    talk = "then that gateway offline note was the talk of our walk and so we laughed until dawn"
    texts = frames + posts + [talk]
    df = spark.createDataFrame([(i, t, f"h{i % 2}") for i, t in enumerate(texts)], "id int, text string, host string")
    ordinary = [*ORDINARY, "kept", "seats", "gate", "rain"]
    got = {r.id: r.reason for r in residue.flagged(df, "text", "host", ordinary=ordinary, phrases="").collect()}
    assert {i for i, r in got.items() if r} == set(range(len(frames))) and "repeated" in got.values()
    one_host = df.withColumn("host", residue.F.lit("one"))
    assert residue.flagged(one_host, "text", "host", ordinary=ordinary, phrases="").where("reason is not null").count() == 0
    copies = spark.createDataFrame([(i, frames[0], f"h{i % 2}") for i in range(9)], "id int, text string, host string")
    assert residue.flagged(copies, "text", "host", ordinary=ordinary, phrases="").where("reason is not null").count() == 0
    assert residue.flagged(df.limit(0), "text", "host").count() == 0


def test_title_that_does_not_fit(spark):
    """A title without a term of the body needs a smaller share of message terms."""
    rows = ["blocked upstream a", "upstream blocked b", "blocked now upstream", "upstream blocked\nour the", "upstream blocked at of"]
    df = spark.createDataFrame([(i, t, f"h{i % 2}") for i, t in enumerate(rows)], "id int, text string, host string")
    got = {r.id: r.reason for r in residue.flagged(df, "text", "host", ordinary=ORDINARY, phrases="").collect()}
    assert got[3] == "repeated" and got[4] != "repeated"


def test_address_slug(spark):
    df = spark.createDataFrame([("https://x.example/threads/summer-tour/", "gateway upstream\nsomething else")], "url string, text string")
    assert residue.evidence(df, "text", "url").first().mismatch
    fits = spark.createDataFrame([("https://x.example/gateway-upstream", "upstream\nupstream gateway")], "url string, text string")
    assert not residue.evidence(fits, "text", "url").first().mismatch


@pytest.mark.parametrize("text", ["lorem ipsum " * 30_000, "[[a " * 50_000, "{{a" * 60_000, "&lt;a" * 40_000, "z" * 300_000, "{" * 100_000, "[your " * 20_000, "x" + " " * 200_000 + "y", "<" * 100_000, "9" * 200_000])
def test_long_runs(spark, text):
    import time

    df = spark.createDataFrame([(text, "h")], "text string, host string")
    began = time.time()
    assert residue.flagged(df, "text", "host").count() == 1
    assert time.time() - began < 60
