import hashlib

from pyspark.sql import functions as F

from tidegraph.config import Config, load_config, quarter_index
from tidegraph.functions import hashing, ids, text, times, vectors
from tidegraph.schemas import EVENTS, exact_columns, mismatches, required_columns


def values(spark, rows, *columns, schema="x string"):
    return [tuple(r) for r in spark.createDataFrame([(r,) for r in rows], schema).select(*columns).collect()]


def test_words_keep_letters_and_digits(spark):
    got = values(spark, ["@Fan_1 héllo, ١٢ wörld!", None, " ", "İstanbul x"], text.words(F.col("x")))
    assert [r[0] for r in got] == [["fan", "1", "héllo", "١٢", "wörld"], [], [], ["i̇stanbul", "x"]]


def test_strip_and_blank(spark):
    got = values(spark, ["\u00a0a b\t\u2003", "\x1c", None], text.strip(F.col("x")), text.is_blank(F.col("x")))
    assert got == [("a b", False), ("", True), (None, True)]


def test_user_objects(spark):
    rows = ["{'id': 1662724992054829056, 'username': 'u1', 'title': None}", '{"id": "12", "username": "b"}', None, "none", "[1]", "{'id': 1.5}", "{'username': 'x'}", "{'id': 7, broken", "not-a-user"]
    got = values(spark, rows, ids.user_object(F.col("x")))
    assert [(r[0].account_id, r[0].ok, r[0].error) for r in got] == [
        ("1662724992054829056", True, None), ("12", True, None), (None, False, "missing_user"), (None, False, "missing_user"), (None, False, "user_not_object"), (None, False, "missing_user_id"), (None, False, "missing_user_id"), ("7", True, "recovered_by_regex"), (None, False, "malformed_user_blob"),
    ]


def test_tweet_ids(spark):
    got = values(spark, [" 8000000000000000001 ", "1.0000000000000002e18", "123", None, "1000000000000000001x"], ids.tweet_id(F.col("x")), ids.tweet_id_error(F.col("x")))
    assert got == [("8000000000000000001", None), (None, "invalid_tweet_id_float"), (None, "invalid_tweet_id"), (None, "invalid_tweet_id"), (None, "invalid_tweet_id")]


def test_nested_and_mentions(spark):
    got = values(spark, ["{'id': 5, 'user': {'name': 'a', 'id': 1001}}", "{'id': 9}", None], ids.nested_user_id(F.col("x")))
    assert [r[0] for r in got] == ["1001", "9", None]
    got = values(spark, ["[{'id': 1002}, {'id': 3}]", "[1, '2']", "nan"], ids.mention_ids(F.col("x")))
    assert [r[0] for r in got] == [["1002", "3"], ["1", "2"], []]


def test_time_reasons(spark):
    c = Config(start_quarter="2018-Q1", end_quarter="2018-Q4")
    rows = [None, "", "abc", "NaN", "631152000", "1496275200", "1559347200", "1519862400", "1519862400000"]
    got = values(spark, rows, times.time_reason(F.col("x"), c))
    assert [r[0] for r in got] == ["MISSING", "MISSING", "UNPARSABLE", "CORRUPT", "EPOCH_OUTLIER", "OUT_OF_RANGE_BEFORE", "OUT_OF_RANGE_AFTER", "IN_RANGE", "IN_RANGE"]


def test_calendar(spark):
    rows = times.calendar(spark).orderBy("snapshot_id").collect()
    assert len(rows) == 35 and rows[0].label == "2017-Q4" and rows[-1].label == "2026-Q2" and rows[1].start == rows[0].end
    assert quarter_index("2018-Q1") - quarter_index("2017-Q4") == 1


def test_hashes(spark):
    want = hashlib.sha256(b"1\x1f2018\x1fabc\x1f0\x1f2\x1f").hexdigest()
    got = values(spark, ["abc"], hashing.event_signature(F.lit("1"), F.lit("2018"), F.col("x"), F.lit(0), F.lit("2")), hashing.content_hash(F.col("x"), 16), hashing.private("t", F.col("x")))
    assert got[0][0] == want and got[0][1] == hashlib.sha256(b"abc").hexdigest()[:16] and got[0][2].startswith("t:")
    assert hashing.canonical_hash({"b": 1, "a": [1]}) == hashing.canonical_hash({"a": [1], "b": 1})
    assert hashing.schema_signature(["b", "a"]) == hashing.schema_signature(["a", "b"]) != hashing.schema_signature(["b", "a"], ordered=True)
    got = values(spark, ["/home/a/b.xlsx", "x/y.csv"], hashing.file_reference(F.col("x")))
    assert got[0][0].startswith("file-") and got[0][0].endswith(".xlsx") and got[1][0] == "y.csv"
    got = values(spark, ["see /home/a/b.xlsx or a@b.org"], hashing.redact_paths_and_mail(F.col("x")))
    assert got[0][0] == "see [path] or [email]"


def test_vectors(spark):
    r = spark.sql("select array(3f, 4f) a, array(0f, 0f) z").select(vectors.norm(F.col("a")).alias("n"), vectors.unit(F.col("a")).alias("u"), vectors.unit(F.col("z")).alias("z"), vectors.cosine(F.col("a"), F.col("z")).alias("c")).first()
    assert r.n == 5 and [round(x, 6) for x in r.u] == [0.6, 0.8] and r.z == [0, 0] and r.c == 0


def test_config_and_schemas(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text('{"start_quarter": "2018-Q1", "max_lengths": [1, 2]}')
    assert load_config(p).snapshots == 34 and load_config(p).fingerprint() != Config().fingerprint()
    p.write_text('{"nonsense": 1}')
    try:
        load_config(p)
        raise AssertionError
    except ValueError:
        pass
    assert exact_columns(["a", "b"], ("a", "c")) == {"matches": False, "missing": ["c"], "unexpected": ["b"]}
    assert required_columns(["a", "b"], ("b",)) == {"b": 1}
    assert mismatches(spark.createDataFrame([], EVENTS), EVENTS) == []


def test_strip_of_long_inner_runs(spark):
    import time

    began = time.time()
    got = values(spark, ["a" + " " * 200_000 + "b ", " " * 200_000], text.strip(F.col("x")))
    assert len(got[0][0]) == 200_002 and got[1][0] == "" and time.time() - began < 30
