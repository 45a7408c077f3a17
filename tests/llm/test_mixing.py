from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidegraph.llm import mixing

TARGETS = [("Big", 0.5, 1), ("small", 0.3, 3), ("tiny_one", 0.2, 6), ("absent", 0.1, 2)]


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, s, n, "clash") for i, (t, s, n) in enumerate(rows)], "doc_id bigint, text string, source string, tokens bigint, share string")
    return docs, spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def corpus():
    rows = [(f"big {i}", ["big", " BIG", "Big "][i % 3], 5 + i % 40) for i in range(900)]
    rows += [(f"small {i}", "small", 10 + i % 20) for i in range(120)] + [(f"tiny {i}", ["tiny-one", "Tiny_One"][i % 2], 20) for i in range(40)]
    return rows + [("big 1", "big", 6)] * 50 + [(None, "big", 0), ("", "small", 0), ("other", "elsewhere", 9), ("none", None, 9)]


def test_shares_and_repeats(spark):
    docs, targets = frames(spark, corpus())
    mixed = mixing.mix(docs, targets, range_rows=50).cache()
    rows = sorted(mixed.collect(), key=lambda r: r.position)
    at = 0
    for r in rows:  # the running total is the order itself, over all ranges
        assert r.position == at
        at += r.tokens
    uses = Counter((r.source, r.doc_id) for r in rows)
    most = {"big": 1, "small": 3, "tiny_one": 6}
    assert all(n <= most[s] for (s, _), n in uses.items()) and len({(r.doc_id, r.copy) for r in rows}) == len(rows)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert max(Counter(text[d] for s, d in uses if s == "big").values()) == 1
    got = {r.source: r for r in mixing.shares(mixed, targets).collect()}
    whole = 0.5 + 0.3 + 0.2
    for s, share in (("big", 0.5), ("small", 0.3), ("tiny_one", 0.2)):
        assert abs(got[s].actual_share - share / whole) < 0.01, got
    assert got["absent"].tokens == 0


def test_budget_and_ranges_do_not_change_the_mix(spark):
    docs, targets = frames(spark, corpus())
    a = {tuple(r) for r in mixing.mix(docs, targets, budget=3000, range_rows=40).collect()}
    b = {tuple(r) for r in mixing.mix(docs, targets, budget=3000, range_rows=10**6).collect()}
    assert a == b and sum(t[4] for t in a) <= 3000 and sum(t[4] for t in a) > 2900


def test_budget_beyond_what_a_source_has(spark):
    """A source that ends early leaves its part to the others, and what is left out is what finishes last."""
    docs, targets = frames(spark, corpus())
    every = mixing.mix(docs, targets, budget=10**9, range_rows=100).collect()
    most = {"big": 1, "small": 3, "tiny_one": 6}
    pool = mixing.candidates(docs, targets).collect()
    assert Counter((r.source, r.doc_id) for r in every) == {(r.source, r.key): most[r.source] for r in pool}
    part = mixing.mix(docs, targets, budget=9000, range_rows=100).collect()
    assert {tuple(r) for r in part} == {tuple(r) for r in every if r.position + r.tokens <= 9000}


def test_small_weight_and_many_texts(spark):
    """Copies that finish after the mix are not made."""
    docs = spark.createDataFrame([(i, f"t{i}", "big" if i < 2000 else "small", 10) for i in range(2020)], "doc_id bigint, text string, source string, tokens bigint")
    targets = spark.createDataFrame([("big", 0.01, 50), ("small", 0.99, 1)], "source string, target_share double, max_repeats int")
    got = Counter(r.source for r in mixing.mix(docs, targets, range_rows=10).collect())
    assert got["small"] == 20 and got["big"] <= 1


def test_one_source_and_empty(spark):
    docs, targets = frames(spark, [(f"t{i}", "small", 10) for i in range(10)])
    per = defaultdict(int)
    for r in mixing.mix(docs, targets).collect():
        per[r.doc_id] += 1
    assert set(per.values()) == {3} and len(per) == 10
    empty, _ = frames(spark, [])
    assert mixing.mix(empty, targets).count() == 0 and mixing.shares(mixing.mix(empty, targets), targets).agg(F.sum("tokens")).first()[0] == 0
