"""Readers, gates, batches and partition metrics on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegraph.functions.frames import numbered
from tidegraph.functions.hashing import schema_signature
from tidegraph.operators import graph, model, pooling, profile, records, selection, validate
from tidegraph.sources import readers, sinks
from tidegraph.streaming import ingest

EDGES = "snapshot_id int, relation_id tinyint, src_index int, dst_index int, count_raw bigint, weight_log1p double"


def test_readers_name_the_first_problem(spark):
    good = (0, 0, 1, 2, 3, math.log1p(3))
    bad = [(0, 0, 1, 1, 1, math.log1p(1)), (0, 9, 1, 2, 1, math.log1p(1)), (None, 0, 1, 2, 1, math.log1p(1)), (0, 0, 1, 7, 1, math.log1p(1)), (0, 0, 1, 2, 0, 0.0), (0, 0, 1, 3, 1, float("nan")), (0, 0, 1, 4, 1, 5.0)]
    got = [r.problem for r in readers.edges(spark.createDataFrame([good, *bad], EDGES), 5).collect()]
    assert got == [None, "self_loop", "out_of_bounds_relation_id", "null_snapshot_id", "out_of_bounds_dst_index", "count_not_positive", "weight_not_finite", "wrong_weight"]
    assert readers.sound(readers.edges(spark.createDataFrame([good], EDGES), 5)).count() == 1
    with pytest.raises(ValueError, match="self_loop: 1 rows"):
        readers.sound(readers.edges(spark.createDataFrame([good, bad[0]], EDGES), 5))


def test_numbers_go_on_over_ranges(spark):
    r = random.Random(1)
    rows = [("hot" if r.random() < 0.5 else r.choice("abc"), i) for i in range(500)]
    got = numbered(spark.createDataFrame(rows, "k string, i int").repartition(7), ["k", "i"], "n").orderBy("n").collect()
    assert [(x.k, x.i) for x in got] == sorted(rows) and [x.n for x in got] == list(range(500))
    assert numbered(spark.createDataFrame([], "k string"), ["k"], "n").count() == 0


def test_batches_and_replays(spark):
    units = spark.createDataFrame([(f"u{i:03d}", f"c{i}") for i in range(25)], "unit_hash string, content_hash string")
    b = selection.unit_batches(units, 10)
    one = {r.batch_key: (r.first_row, r.rows, r.input_hash) for r in b.collect()}
    assert sorted(one) == ["b00000000-o000000000000", "b00000001-o000000000010", "b00000002-o000000000020"] and [one[k][1] for k in sorted(one)] == [10, 10, 5]
    again = selection.unit_batches(units.repartition(5).withColumn("content_hash", F.when(F.col("unit_hash") == "u012", "new").otherwise(F.col("content_hash"))), 10)
    got = {r.batch_key: r.outcome for r in selection.replay_outcome(again, b.where("first_row < 20")).collect()}
    assert got == dict(zip(sorted(one), ["committed", "conflict", "new"]))


def test_batches_are_committed_once(spark, tmp_path):
    at = str(tmp_path / "t")
    df = spark.range(10)
    assert ingest.commit_batch(df, at, 0) and not ingest.commit_batch(df.repartition(3), at, 0) and ingest.commit_batch(df, at, 1)
    with pytest.raises(ValueError, match="other rows"):
        ingest.commit_batch(spark.range(11), at, 0)
    assert ingest.committed(spark, at).count() == 20
    ingest.guard(tmp_path, "s", {"a": "1"})
    ingest.guard(tmp_path, "s", {"b": "2"})
    with pytest.raises(ValueError, match="a"):
        ingest.guard(tmp_path, "s", {"a": "3"})


def test_insert_into_a_table_without_the_key_is_an_error(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    new = spark.createDataFrame([("a", 1)], "k string, n int")
    with pytest.raises(Exception, match="k"):
        sinks.insert_ignore(new, str(tmp_path / "t"), ["k"], ["n"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_sealed_reports_on_any_file_system(spark, tmp_path):
    at = f"file://{tmp_path}/r"
    sinks.seal({"calendar": {"rows": 3}}, at, "c")
    assert sinks.verify(at) == [] and sinks.verify(f"file://{tmp_path}/none") == ["manifest is missing"]
    (tmp_path / "r/calendar.json").write_text("{}")
    assert sinks.verify(at) == ["calendar has changed"]


def test_gates(spark):
    e = spark.createDataFrame([(0, 0, 0, 1, 1, math.log1p(1)), (0, 0, 1, 1, 1, 9.0)], EDGES)
    t = spark.createDataFrame([(0, 0, 1)], "snapshot_id int, node_index int, tweet_count bigint")
    nodes = spark.createDataFrame([("a", 0), ("b", 1)], "account_id string, node_index int")
    got = {r.gate: r.passed for r in validate.graph_gates(graph.structural_features(e, t), e, e, nodes, 2).collect()}
    assert len(got) == 12 and {g for g, ok in got.items() if not ok} == {"no_self_loops", "weight_log1p_ok"}
    schema = "tweet_id string, node_index int, snapshot_id int, created_at_utc timestamp, record_status string, exclusion_reason string, source_file string, source_row_number bigint"
    import datetime

    now = datetime.datetime(2020, 1, 1)
    r = spark.createDataFrame([("123456789012345", 1, 3, now, "Retained ", None, "f", 1), ("1.5e18", None, 99, None, "retained", "x", "f", 1), (None, None, None, None, "excluded", None, "f", 2)], schema)
    got = {x.gate: x.passed for x in validate.record_gates(r, 3, 10).collect()}
    assert len(got) == 11 and {g for g, ok in got.items() if ok} == {"node_index_in_range", "statuses_known", "row_accounting_balances", "has_retained"}


def test_privacy_and_roles():
    found = validate.privacy_findings({"Text": 1, "a": "see 1234567", "b": "12345", "c": ["x 99 y"]}, known_ids=frozenset({"1234567", "99"}))
    assert found == ["$.Text: forbidden key", "$.a: known id", "$.c[0]: known id"]
    assert profile.column_roles([" Tweet_ID", "user", "created-at", "odd"]) == {**dict.fromkeys(profile.ROLES, []), "tweet_id": [" Tweet_ID"], "author_user_blob": ["user"], "timestamp": ["created-at"]}
    assert schema_signature([" A", "b"]) == schema_signature(["B ", "a"]) != schema_signature(["a", "b", "c"])
    assert validate.relation_map_violations({"a": 0, "c": 2}, ["a", "b"]) == ["b is missing", "c is unknown"]
    assert graph.graph_name("9 odd-name" + "x" * 99) == ("g_9_odd_name" + "x" * 99)[:63]


def test_adapters_by_name():
    from tidegraph.sources.adapters import adapter

    assert adapter("graph_sheet") is graph.sheet_interactions
    with pytest.raises(ValueError, match="event_table, graph_sheet, text_sheet"):
        adapter("other")


def test_weighted_loss(spark):
    one = lambda x: spark.createDataFrame([(x,)], "loss double")
    r = model.weighted_loss({"a": (2.0, one(1.5)), "b": (0.5, one(None)), "c": (1.0, one(0.25))}).first()
    assert (r.a, r.b, r.c, r.total) == (1.5, None, 0.25, 3.25)


def test_snapshot_order(spark):
    rows = [(0, "2020-01-01", "2020-04-01"), (1, "2020-04-01", "2020-07-01"), (3, "2020-10-01", "2021-01-01"), (3, "2020-10-01", "2021-01-01"), (4, "2021-02-01", "2021-04-01")]
    df = spark.createDataFrame(rows, "snapshot_id int, start string, end string").selectExpr("snapshot_id", "date(start) start", "date(end) end")
    assert [(r.snapshot_id, r.problem) for r in validate.snapshot_order_violations(df).collect()] == [(3, "gap_in_numbers"), (3, "repeated"), (4, "gap_in_time")]


def test_repeats_by_scope(spark):
    rows = [("x", "a", "2020-01-01"), ("x", "a", "2020-01-02"), ("y", "a", "2020-01-01"), ("y", "b", "2020-01-01"), ("z", "a", "2020-01-01"), ("z", "a", "2020-01-01"), ("w", None, None), ("w", None, None), (" ", "a", None), ("v", "a", None)]
    df = spark.createDataFrame(rows, "text_normalized string, author_account_id string, t string").selectExpr("text_normalized", "author_account_id", "timestamp(t) created_at_utc")
    assert {(r.scope, r.texts, r.rows) for r in records.repeats_by_scope(df).collect()} == {("same_author_other_time", 1, 2), ("several_authors", 1, 2), ("same_author_same_time", 1, 2), ("no_author", 1, 2)}


@pytest.mark.parametrize("a, b, n", [(5, 7, 20), (1, 1, 1), (30, 40, 60), (3, 3, 1000), (600, 500, 1000)])
def test_expected_mutual_information(a, b, n):
    total = 0.0
    for i in range(max(1, a + b - n), min(a, b) + 1):
        p = math.comb(a, i) * math.comb(n - a, b - i) / math.comb(n, b)
        total += i / n * math.log(n * i / (a * b)) * p
    assert model.expected_mutual_information(a, b, n) == pytest.approx(total, abs=1e-12)


def test_agreement_of_equal_and_single_partitions(spark):
    t = spark.createDataFrame([(0, 0, 5), (1, 1, 7)], "u int, v int, n bigint")
    r = model.partition_agreement(t).first()
    assert r.ami == pytest.approx(1) and r.ari == pytest.approx(1) and r.nvi == pytest.approx(0)
    one = model.partition_agreement(spark.createDataFrame([(0, 0, 1)], "u int, v int, n bigint")).first()
    assert one.ami == one.ari == 1.0
    assert model.partition_agreement(t.limit(0)).count() in (0, 1)


def test_fingerprint_of_a_hub(spark):
    """A source with thousands of targets is a tree of hashes; the order of rows does not matter, any change does."""
    rows = [(0, 0, 5, i) for i in range(3000)] + [(0, 0, s, 1) for s in range(6, 2000, 7)]
    df = spark.createDataFrame(rows, "snapshot_id int, relation_id tinyint, src_index int, dst_index int")
    a, b = (pooling.order_fingerprint(x).first() for x in (df, df.repartition(5, "dst_index")))
    assert a == b and a.edges == len(rows)
    assert pooling.order_fingerprint(df.where("not (src_index = 5 and dst_index = 2999)")).first().fingerprint != a.fingerprint


def test_neighbour_overlap(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "k int, v array<double>").repartition(4)
    got = {r.k: r.overlap for r in model.neighbour_overlap(df.where("k % 20 = 0"), df, "k", "v", 3, 5).collect()}

    def near(size, q):
        s = v[:, :size] @ v[q, :size] / np.linalg.norm(v[:, :size], axis=1) / np.linalg.norm(v[q, :size])
        s[q] = -2
        return set(np.lexsort((np.arange(60), -s))[:5])

    assert got == {q: pytest.approx(len(near(8, q) & near(3, q)) / 5) for q in (0, 20, 40)}


def test_kmeans_restarts_and_empty_clusters(spark):
    rng = np.random.default_rng(5)
    centres = np.array([[0, 0], [10, 0], [0, 10], [10, 10]], dtype=float)
    points = [(i, (centres[i % 4] + rng.normal(scale=0.3, size=2)).tolist()) for i in range(80)]
    df = spark.createDataFrame(points + [(999, None)], "k int, v array<double>").repartition(3)
    best = model.kmeans(df, "k", "v", 4, restarts=3)
    got = sorted(tuple(round(x) for x in c) for c in best["centres"])
    assert got == [(0, 0), (0, 10), (10, 0), (10, 10)] and best["inertia"] < 80 * 0.3**2 * 2 * 1.5
    again = model.kmeans(df.repartition(5), "k", "v", 4, restarts=3)
    assert np.allclose(again["centres"], best["centres"]) and again["rounds"] == best["rounds"]
    few = model.kmeans(df.where("k < 2"), "k", "v", 4)
    assert few["inertia"] == pytest.approx(0) and len(few["centres"]) == 2
    with pytest.raises(ValueError):
        model.kmeans(df.limit(0), "k", "v", 2)
