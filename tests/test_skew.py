from collections import Counter, defaultdict

from tidegraph.operators import skew

SCHEMA = "author_account_id string, target_account_id string, relation_id tinyint, extra string"


def events(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def test_heavy_accounts_trims_and_counts_all_rows(spark):
    rows = [("1", "2", 0)] * 5 + [("\u00a01 ", None, 1)] * 5 + [(None, "3", 2)] * 85 + [(" ", "4", 3)] * 405
    got = {tuple(r)[:2] for r in skew.heavy_accounts(events(spark, rows), spark.createDataFrame([("1", 0)], "account_id string, node_index int")).select("role", "account_id").collect()}
    assert got == {("author", "1"), ("target", "2"), ("target", "3"), ("target", "4")}


def test_profile_against_python(spark):
    rows = [(str(i % 7), str(i % 11) if i % 5 else None, i % 5 if i % 13 else None) for i in range(500)] + [("0", "0", 0)] * 300
    states = defaultdict(lambda: [0, set(), Counter()])
    for a, t, r in rows:
        for role, me, other in (("author", a, t), ("target", t, a)):
            if me is not None:
                s = states[role, me]
                s[0] += 1
                s[1] |= {other} - {None}
                s[2][r] += 1
    universe = spark.createDataFrame([("0", 5), ("0", 3), ("1", 1)], "account_id string, node_index int")
    got = skew.account_profile(events(spark, rows), universe).collect()
    assert len(got) == len(states)
    for r in got:
        n, others, rel = states[r.role, r.account_id]
        assert (r.events, r.counterparts, r.mention, r.quote) == (n, len(others), rel[0], rel[3])
    assert {r.node_index for r in got if r.account_id == "0"} == {3}


def test_eager_join_equals_the_join(spark):
    left = spark.createDataFrame([(i % 3 if i % 10 else None, i, i) for i in range(60)], "k int, v bigint, rows int")
    right = spark.createDataFrame([(i % 4, i * 2, str(i % 2)) for i in range(20)], "k int, w bigint, g string")
    joined = left.join(right, "k")
    want = {r.k: (r.n, r.v, r.w) for r in joined.groupBy("k").agg({"*": "count", "v": "sum", "w": "sum"}).toDF(*[c for c in joined.groupBy("k").agg({"*": "count", "v": "sum", "w": "sum"}).columns]).selectExpr("k", "`count(1)` n", "`sum(v)` v", "`sum(w)` w").collect()}
    got = {r.k: (r.rows, r.sum_v, r.sum_w) for r in skew.eager_join_aggregate(left, right, "k", ["v"], ["w"]).collect()}
    assert got == want
    by = {r.g: r.rows for r in skew.eager_join_aggregate(left, right, "k", by="g").collect()}
    assert by == {r.g: r["count"] for r in joined.groupBy("g").count().collect()}


def test_empty(spark):
    e = events(spark, [("1", "2", 0)]).limit(0)
    u = spark.createDataFrame([], "account_id string, node_index int")
    assert skew.account_profile(e, u).count() == 0 and skew.heavy_accounts(e, u).count() == 0
