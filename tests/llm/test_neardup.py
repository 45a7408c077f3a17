import random
from collections import defaultdict

import pytest
import regex

from tidegraph.llm import neardup

WORD = regex.compile(r"[\p{L}\p{N}]+")


def brute(texts):
    sets = {k: {w.lower() for w in WORD.findall(t)} for k, t in texts.items() if k is not None and t is not None}
    keys = sorted(k for k, s in sets.items() if len(s) >= 8)
    out = set()
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            common = len(sets[a] & sets[b])
            if 10 * common >= 7 * len(sets[a] | sets[b]):
                out.add((a, b))
    return out


def made(seed, n=120, vocabulary=60):
    """Texts over a small vocabulary, many of them edited copies."""
    r = random.Random(seed)
    texts = {}
    for i in range(n):
        if texts and r.random() < 0.6:
            ws = WORD.findall(r.choice(list(texts.values())))
            for _ in range(r.randint(0, 4)):
                at = r.randrange(len(ws) + 1)
                ws[at : at + r.randint(0, 1)] = [f"w{r.randrange(vocabulary)}"] * r.randint(0, 1)
            r.shuffle(ws)
        else:
            ws = [f"w{int(r.paretovariate(0.7)) % vocabulary}" for _ in range(r.randint(5, 40))]
        texts[f"{i:04d}"] = " ".join(ws).upper() if r.random() < 0.1 else " ".join(ws)
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_brute_force(spark, seed):
    texts = made(seed)
    df = spark.createDataFrame([(k, t, 1) for k, t in texts.items()] * 2, "h string, t string, key int")
    got = [tuple(r) for r in neardup.similar_pairs(df, "h", "t").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(texts)


def test_few_frequent_words_lose_nothing(spark):
    """With hardly any word counted as frequent the order is poorer but the pairs are the same."""
    texts = made(9)
    df = spark.createDataFrame(list(texts.items()), "h string, t string")
    t = neardup.distinct_texts(df, "h", "t")
    pairs = {tuple(sorted(r)) for r in neardup.candidate_pairs(neardup.postings(t, frequent_words=3)).collect()}
    assert brute(texts) <= pairs


def test_whole_small_table(spark, data):
    df = spark.read.parquet(f"{data}/graph_events.parquet").select("text_hash", "cleaned_text")
    texts = {r.text_hash: r.cleaned_text for r in df.distinct().collect()}
    assert {tuple(r) for r in neardup.similar_pairs(df, "text_hash", "cleaned_text").collect()} == brute(texts)


def test_nulls_empty_long_and_ties(spark):
    long = " ".join(f"x{i}" for i in range(20_000))
    rows = [(None, "a b c d e f g h"), ("n", None), ("e", ""), ("l1", long), ("l2", long + " y"), ("s1", "a b c d e f g h"), ("s2", "h g f e d c b a"), ("s3", "a b c d e f g")]
    df = spark.createDataFrame(rows, "h string, t string")
    assert {tuple(r) for r in neardup.similar_pairs(df, "h", "t").collect()} == {("l1", "l2"), ("s1", "s2")}
    assert neardup.similar_pairs(df.limit(0), "h", "t").count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(30)]
    star = [("s0", f"s{i}") for i in range(1, 9)]
    df = spark.createDataFrame(chain + star + [("b", "a"), ("a", "b")], "a string, b string")
    got = defaultdict(set)
    for r in neardup.components(df).collect():
        got[r.root].add(r.node)
    assert {k: len(v) for k, v in got.items()} == {"c00": 31, "s0": 9, "a": 2}
    assert neardup.components(df.limit(0)).count() == 0


def test_groups_count_links(spark):
    base = [f"w{i}" for i in range(20)]
    texts = {"a": base, "b": [*base[:18], "p", "q"], "c": [*base, "z"], "d": [f"v{i}" for i in range(20)]}
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "h string, t string")
    assert {tuple(r) for r in neardup.duplicate_groups(df, "h", "t").collect()} == {("a", "a", 2), ("b", "a", 2), ("c", "a", 2)}


def test_copies_are_counted_not_paired(spark):
    """Texts of one set of words are one class; their links are counted."""
    base = [f"w{i}" for i in range(20)]
    texts = {f"c{i:02d}": " ".join(base[i:] + base[:i]) for i in range(20)} | {f"d{i}": " ".join(["x", "y", *base[:-1]]) + "!" * i for i in range(3)} | {"e": " ".join(f"v{i}" for i in range(9))}
    df = spark.createDataFrame(list(texts.items()), "h string, t string")
    got = {r.key: (r.group, r.links) for r in neardup.duplicate_groups(df, "h", "t").collect()}
    assert got == {k: ("c00", 22) for k in texts if k != "e"}
    assert neardup.class_pairs(neardup.distinct_texts(df, "h", "t")).count() == 1
    assert {tuple(r) for r in neardup.similar_pairs(df, "h", "t").collect()} == brute(texts)


def test_parts_of_long_lists_lose_nothing(spark):
    texts = made(4)
    df = spark.createDataFrame(list(texts.items()), "h string, t string")
    t = neardup.distinct_texts(df, "h", "t")
    few = {tuple(sorted(r)) for r in neardup.candidate_pairs(neardup.postings(t)).collect()}
    many = [tuple(sorted(r)) for r in neardup.candidate_pairs(neardup.postings(t, part_postings=2)).collect()]
    assert set(many) == few and len(many) == len(few)
