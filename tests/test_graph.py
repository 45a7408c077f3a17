import math

import pytest
from pyspark.sql import functions as F

from tidegraph.config import Config
from tidegraph.functions.text import normalized_text
from tidegraph.operators import diagnostics, graph, model, records, validate

EDGES = "snapshot_id int, relation_id tinyint, src_index int, dst_index int, count_raw bigint, weight_log1p double"


def edge(spark, rows):
    return spark.createDataFrame([(*r, math.log1p(r[4])) if len(r) == 5 else r for r in rows], EDGES)


def test_features_of_one_edge(spark):
    e = edge(spark, [(0, 0, 0, 1, 2)])
    t = spark.createDataFrame([(0, 0, 1), (0, 2, 3)], "snapshot_id int, node_index int, tweet_count bigint")
    got = {r.node_index: r for r in graph.structural_features(e, t).collect()}
    assert set(got) == {0, 1, 2} and all(r.struct_active for r in got.values())
    assert got[0].mention_out_degree == 1 and got[0].mention_out_strength_log1p == pytest.approx(math.log(3)) and got[2].tweet_count_log1p == pytest.approx(math.log(4)) and got[1].mention_in_degree == 1


def test_sheet_to_events(spark):
    rows = [("a", 2, "1519862400", "{'id': 100}", "hello @b", "[{'id': 200}]", None, None, None), ("a", 3, "1519862400", "{'id': 100}", "me", "[{'id': 100}]", None, None, None), ("a", 4, "1522540800", "{'id': 200}", None, None, "{'user': {'id': 100}}", None, None)]
    sheet = spark.createDataFrame(rows, "source_file string, source_row_number bigint, created_at string, user string, text string, user_mentions string, retweeted_status string, reply_status string, quoted_status string")
    nodes = spark.createDataFrame([("100", 0), ("200", 1), ("300", 2)], "account_id string, node_index int")
    i = graph.sheet_interactions(sheet)
    assert {(r.reason, r.rows) for r in graph.ladder_counts(i, nodes).collect()} == {("event", 2), ("self_loop", 1)}
    ev = graph.relation_events(i, nodes)
    assert {(r.relation_id, r.source_idx, r.target_idx) for r in ev.collect()} == {(0, 0, 1), (1, 1, 0)} and all(len(r.signature) == 64 for r in ev.collect())
    assert {(r.node_index, r.tweet_count) for r in graph.authored_counts(i, nodes).collect()} == {(0, 2), (1, 1)}
    assert graph.edges(ev.unionByName(ev)).agg(F.sum("count_raw")).first()[0] == 2


def test_events_take_times_in_any_form(spark):
    rows = [(1, "f", 1, "100", "200", 0, "2018-03-01 09:00:00", "e\u0301", "s1"), (2, "f", 2, "100", "200", 0, "1519862400", " \u00a0", "s2"), (3, "g", 1, "100", "200", 0, "01.03.2018 00:00", None, "s3"), (4, "g", 2, "100", "200", 0, "soon", "x", "s4")]
    e = spark.createDataFrame(rows, "event_id bigint, source_file string, source_row_number bigint, author_account_id string, target_account_id string, relation_id tinyint, created_at_utc_iso string, cleaned_text string, signature string")
    sources = spark.createDataFrame([("f", "+09:00")], "source_file string, timezone_assumption string")
    nodes = spark.createDataFrame([("100", 0), ("200", 1)], "account_id string, node_index int")
    i = graph.event_interactions(e, sources)
    assert {r.signature: str(r.created) for r in i.collect()} == {"s1": "2018-03-01 00:00:00", "s2": "2018-03-01 00:00:00", "s3": "2018-03-01 00:00:00", "s4": "None"}
    assert {(r.reason, r.rows) for r in graph.ladder_counts(i, nodes).collect()} == {("event", 3), ("invalid_timestamp", 1)}
    got = {r.signature: (r.cleaned_text, r.text_quality, r.text_hash) for r in graph.relation_events(i, nodes).collect()}
    assert got["s1"][:2] == ("\u00e9", "ok") and got["s2"][1] == "whitespace_only" and got["s3"][1] == "empty" and got["s2"][2] == got["s3"][2] == "e3b0c44298fc1c14"


def test_edge_checks(spark):
    good = [(0, 0, 0, 1, 3), (0, 0, 1, 0, 1), (0, 1, 0, 2, 2), (2, 0, 0, 3, 1)]
    assert validate.edge_violations(edge(spark, good)).count() == 0
    bad = edge(spark, [*good, (0, 0, 5, 5, 1), (0, 0, 0, 1, 9), (0, 3, 1, 2, 0), (0, 3, 1, 3, 3, 1.0), (0, 7, 1, 3, 1)])
    assert {(r.problem, r.edges) for r in validate.edge_gates(bad).collect()} == {("self_loop", 1), ("repeated_key", 1), ("count_not_positive", 1), ("wrong_weight", 1), ("wrong_relation", 1)}


def test_variants_and_neighbours(spark):
    e = edge(spark, [(0, 0, 0, 1, 2), (0, 1, 0, 1, 3), (0, 0, 1, 0, 1)])
    assert {tuple(r)[:5] for r in graph.symmetrized(e).collect()} == {(0, 0, 0, 1, 3), (0, 0, 1, 0, 3), (0, 1, 0, 1, 3), (0, 1, 1, 0, 3)}
    assert {(r.src_index, r.dst_index, r.count_raw) for r in graph.collapsed(e).collect()} == {(0, 1, 5), (1, 0, 1)}
    nodes = spark.createDataFrame([("a", 0), ("b", 1)], "account_id string, node_index int")
    assert {(r.relation_id, r.account_id) for r in graph.neighbours(e, nodes, 0, 0).collect()} == {(0, "b"), (1, "b")}


def test_node_map_is_numeric_order(spark):
    got = {r.account_id: r.node_index for r in graph.node_map(spark.createDataFrame([("10",), ("9",), ("9 ",), (None,), ("x",), ("1001",), ("100000000000000000000",)], "account_id string")).collect()}
    assert got == {"9": 0, "10": 1, "1001": 2, "100000000000000000000": 3}


def test_normalisation_ladder(spark):
    good, old, u = "1588291200", "1420070400", "{{'id': {}, 'username': 'n'}}"
    rows = [
        ("t1", 2, "1000000000000000001", good, u.format(100), "hello"), ("t1", 3, "1000000000000000002", good, u.format(101), "world"), ("t1", 4, "1000000000000000003", good, u.format(999), "outsider"), ("t1", 5, "1000000000000000004", old, u.format(102), "too old"),
        ("t1", 6, "1.0000000000000002e18", good, u.format(100), "floatid"), ("t1", 7, "1000000000000000006", good, "not-a-user", "baduser"), ("t1", 8, "1000000000000000007", "bad-ts", u.format(100), "badts"), ("t2", 2, "1000000000000000001", good, u.format(100), "hello"),
        ("t2", 3, "1000000000000000002", good, u.format(101), "DIFFERENT"), ("t2", 4, "1000000000000000010", good, u.format(102), "unique"),
    ]
    full = [(i, c, usr, t, *["1"] * 6, f, "Sheet1", n) for f, n, i, c, usr, t in rows]
    raw = spark.createDataFrame(full, "id string, created_at string, user string, text string, likes string, retweets string, reply_count string, quoted_count string, bookmarks string, views string, source_file string, source_sheet string, source_row_number bigint")
    nodes = spark.createDataFrame([("100", 0), ("101", 1), ("102", 2)], "account_id string, node_index int")
    done = records.normalise(raw, nodes)
    assert len(done.columns) == 24
    got = {(r.source_file, r.source_row_number): (r.record_status, r.exclusion_reason) for r in done.collect()}
    assert [v[0] for v in got.values()].count("retained") == 5 and got["t1", 4] == ("excluded", "author_not_in_frozen_universe") and got["t1", 5] == ("excluded", "outside_canonical_snapshot_range")
    assert got["t1", 6] == ("rejected", "invalid_tweet_id_float") and got["t1", 7] == ("rejected", "malformed_user_blob") and got["t1", 8] == ("rejected", "invalid_timestamp")
    report = {r.tweet_id: r for r in records.duplicate_report(done.where("record_status = 'retained'")).collect()}
    assert report["1000000000000000001"].duplicate_type == "exact_duplicate" and report["1000000000000000002"].duplicate_type == "conflicting_id" and report["1000000000000000001"].source_locations == "t1:2;t2:2"


def test_dedup_summary(spark):
    rows = [("9001", "same", "a", 1), ("9001", "same", "b", 1), ("9002", "left", "b", 2), ("9002", "right", "b", 3), ("9003", "unique", "c", 1)]
    df = spark.createDataFrame(rows, "k string, c string, source_file string, source_row_number bigint")
    g = records.duplicate_groups(df, F.col("k"), F.col("c"))
    assert tuple(records.duplicate_summary(g).first()) == (3, 2, 1, 1, 1, 1, 2)
    assert {tuple(r) for r in records.multiplicity(g).collect()} == {(1, 1), (2, 2)}


def test_text_normalisation(spark):
    df = spark.createDataFrame([("\ufeffa\r\nb\rc",), ("e\u0301",), (None,), (" ",)], "t string")
    assert [r.n for r in normalized_text(df, "t", "n").collect()] == ["a\nb\nc", "é", None, " "]


def test_carry_and_scatter(spark):
    df = spark.createDataFrame([(1, 0, 5.0, True), (1, 1, 6.0, False), (1, 2, 7.0, True), (2, 0, 1.0, False)], "n int, t int, v double, a boolean")
    assert [(r.n, r.t, r.state) for r in model.carried_state(df, "n", "t", "v", "a").orderBy("n", "t").collect()] == [(1, 0, 5.0), (1, 1, 5.0), (1, 2, 7.0), (2, 0, None)]
    m = spark.createDataFrame([(0, 1.0), (0, 3.0), (2, 5.0)], "i int, x double")
    assert {tuple(r)[:2] for r in model.scatter_mean(m, ["i"], "x").collect()} == {(0, 2.0), (2, 5.0)}


def test_empty_graph(spark):
    e = edge(spark, [])
    t = spark.createDataFrame([], "snapshot_id int, node_index int, tweet_count bigint")
    assert graph.structural_features(e, t).count() == 0 and graph.edge_ordinals(e).count() == 0
    q = diagnostics.empty_quarters(diagnostics.calendar_report(spark.createDataFrame([], "snapshot_id int, node_index int, created timestamp_ntz"), __import__("tidegraph.functions.times", fromlist=["calendar"]).calendar(spark, Config())))
    assert {r.position for r in q.collect()} == {"leading"}
