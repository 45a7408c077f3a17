import json

import brute_drift
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st

from tidegraph.operators import drift

SCHEMA = "feed_id string, file_seq int, source_file string, source_sheet string, source_row_number bigint, record_json string"
CONTRACT = [("s", i, c, t, 1, 1) for i, (c, t) in enumerate([("id", "string"), ("likes", "integer"), ("text", "string")], 1)]


def raw(spark, files):
    rows = [(f, q, n, "S", i, r if isinstance(r, str) or r is None else json.dumps(r)) for f, q, n, rs in files for i, r in enumerate(rs, 2)]
    return spark.createDataFrame(rows, SCHEMA)


def contract(spark):
    return spark.createDataFrame(CONTRACT, "family_sig string, column_position int, column_name string, json_type string, column_order_variants int, n_schema_families int")


def post(i):
    return str(3 * 10**18 + i)


def test_whole_table_against_plain_reading(spark, data):
    t = spark.read.parquet(f"{data}/dataset_b_raw.parquet")
    got = [tuple(r) for r in drift.changes(t).collect()]
    p = t.toPandas()
    files = [(f, q, n, [json.loads(x) for x in g.record_json]) for (f, q, n), g in p.groupby(["feed_id", "file_seq", "source_file"])]
    assert len(got) == len(set(got)) and set(got) == brute_drift.changes(files)


def test_each_change(spark):
    one = [{"id": post(i), "likes": i, "text": f"t{i}", "old": "x", "views": i} for i in range(8)]
    two = [{"text": f"t{i}", "status": post(i), "likes": str(i), "views": i, "new": True} for i in range(4, 12)]
    files = [("f", 1, "a", one), ("f", 3, "b", two)]
    got = {tuple(r) for r in drift.changes(raw(spark, files)).collect()}
    assert got == {("b", "removed", "old"), ("b", "added", "new"), ("b", "renamed", "status"), ("b", "retyped", "likes"), ("b", "reordered", "*")}
    assert got == brute_drift.changes(files)


def test_nulls_broken_rows_and_empty(spark):
    files = [("f", 1, "a", [{"id": post(1), "x": None}, "no json", None, "[1]", "{}"]), ("f", 2, "b", [{"id": post(1), "x": None, "y": None}, {"id": post(1)}])]
    assert {tuple(r) for r in drift.changes(raw(spark, files)).collect()} == {("b", "added", "y")}
    assert drift.changes(raw(spark, [])).count() == 0


def test_unified_keeps_values_and_names(spark):
    one = [{"id": post(i), "likes": i, "text": "a" * 70_000 if i == 1 else "t"} for i in range(4)]
    two = [{"id": int(post(i)), "Likes": "n/a" if i == 5 else str(i), "text": None, "place": "p"} for i in range(2, 6)]
    rows = drift.unify(raw(spark, [("f", 1, "a", one), ("f", 2, "b", two + two[:1])]), contract(spark)).collect()
    assert len(rows) == 9
    by = {(r.source_file, r.source_row_number): r for r in rows}
    assert by["b", 2].id == post(2) and by["b", 2].likes == 2 and by["b", 2].branches.integer == {"id": int(post(2))} and by["b", 2].branches.string == {"likes": "2"} and by["b", 2].extras == {"place": ["p"]}
    assert by["b", 5].likes is None and by["b", 5].branches.string == {"likes": "n/a"} and by["b", 5].branches.fraction == {}
    assert len(by["a", 3].text) == 70_000
    kinds = {(r.canonical, r.type): r.first_seq for r in drift.alternatives(raw(spark, [("f", 1, "a", one), ("f", 2, "b", two)]), contract(spark)).collect()}
    assert kinds["likes", "integer"] == 1 and kinds["likes", "string"] == 2


def test_clashing_names_lose_nothing(spark):
    """Two columns of one file that fold to one name, a key given twice, and values that differ from what they are called."""
    one = [{"Likes": 1, "likes": 2, "LIKES": 3, "id": post(1)}, '{"id": "%s", "likes": 4, "likes": 5}' % post(2), {"id": post(3), "likes": 1.5, "text": True}]
    by = {r.source_row_number: r for r in drift.unify(raw(spark, [("f", 1, "a", one)]), contract(spark)).collect()}
    assert by[2].likes == 2 and by[2].extras == {"Likes": ["1"], "LIKES": ["3"]}
    assert by[3].likes == 4 and by[3].extras == {"likes": ["5"]}
    assert by[4].likes == 1 and by[4].branches.fraction == {"likes": 1.5} and by[4].text == "true" and by[4].branches.boolean == {"text": True}


def test_alternatives_inside_of_nested_values(spark):
    one = [{"id": post(1), "user": {"id": 7, "tags": ["a"], "odd name, x": None}}, {"id": post(2), "user": {"id": "7", "tags": [1.5]}}, {"id": post(3), "user": "blob"}]
    got = {(r.canonical, r.type): r["values"] for r in drift.alternatives(raw(spark, [("f", 1, "a", one)]), contract(spark)).collect()}
    assert got == {
        ("id", "string"): 3, ("user", "object"): 2, ("user", "string"): 1, ("user.id", "integer"): 1, ("user.id", "string"): 1, ("user.tags", "array"): 2, ("user.tags[]", "string"): 1, ("user.tags[]", "fraction"): 1, ("user.odd name, x", "null"): 1,
    }


def test_many_files_meet_by_a_shuffle(spark, monkeypatch):
    one = [{"id": post(i), "likes": i, "old": f"x{i}"} for i in range(6)]
    two = [{"id": post(i), "likes": i, "young": f"x{i}"} for i in range(3, 9)]
    files = [("f", 1, "a", one), ("f", 2, "b", two)]
    few = drift.changes(raw(spark, files)).collect(), sorted(map(str, drift.unify(raw(spark, files), contract(spark)).collect()))
    monkeypatch.setattr(drift, "BROADCAST_FILES", 0)
    assert (drift.changes(raw(spark, files)).collect(), sorted(map(str, drift.unify(raw(spark, files), contract(spark)).collect()))) == few and tuple(few[0][0]) == ("b", "renamed", "young")


VALUE = st.one_of(st.none(), st.integers(-5, 5), st.booleans(), st.sampled_from(["a", "b", "1"]), st.sampled_from([0.5, 2.0]))


FILE = st.lists(st.sampled_from("pqrs"), unique=True, max_size=4).flatmap(lambda cols: st.lists(st.tuples(*[VALUE for _ in cols]).map(lambda vs: dict(zip(cols, vs))), min_size=2, max_size=4))


@settings(max_examples=6, deadline=None, phases=[Phase.generate], suppress_health_check=list(HealthCheck))
@given(st.lists(FILE, min_size=1, max_size=3))
def test_random_files(spark, files):
    made = [("f", q, f"n{q}", [{"id": post(i), **r} for i, r in enumerate(rows)]) for q, rows in enumerate(files)]
    assert {tuple(r) for r in drift.changes(raw(spark, made)).collect()} == brute_drift.changes(made)
