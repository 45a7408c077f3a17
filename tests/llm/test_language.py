import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegraph.llm import language


@pytest.fixture(scope="module")
def samples(data):
    t = pd.read_parquet(f"{data}/lang_samples.parquet")
    return [(a, b) for a, b in zip(t.lang, t.text)]


def test_held_out_accuracy(samples):
    rows = sorted(samples)
    random.Random(3).shuffle(rows)
    half = len(rows) // 2
    model = language.Model(rows[:half])
    right = sum(language.LANGUAGES[model.classify(language.content_words(t))[0]] == lang for lang, t in rows[half:])
    assert right >= 0.97 * (len(rows) - half)


def test_mixed_texts_of_held_out_samples(samples):
    rows = sorted(samples)
    random.Random(4).shuffle(rows)
    half = len(rows) // 2
    model, rest, right, n = language.Model(rows[:half]), rows[half:], 0, 0
    for (a, x), (b, y) in zip(rest, rest[1:]):
        if a != b and min(len(language.content_words(x)), len(language.content_words(y))) >= 8:
            n += 1
            right += [s[1] for s in language.describe(model, f"{x}\n{y}")] == [a, b]
    assert n > 20 and right >= 0.9 * n


def test_labels(spark):
    rows = ["en", "EN", " English ", "en-US", "pt_BR", "fre", "in", "per", "und", "", None, "zxx", "??", "N/A", "unknown", "de-AT"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "x string").select(language.label_code(F.col("x"))).collect()]
    assert got == ["en", "en", "en", "en", "pt", "fr", "id", "fa", None, None, None, None, None, None, None, "de"]


def test_defined_results(samples):
    model = language.Model(samples)
    assert language.describe(model, None) == [] and language.describe(model, "") == [] and language.describe(model, "the fans saved it") == []
    assert language.describe(model, "1 2 3 4 5 @a #b") == []
    assert language.describe(model, "漢字仮名交じり文 と 漢字 の 文章 です 漢字") == []
    (_, lang, confidence, words), = language.describe(model, "before the show the quiet accounts waited for the ticket queue " * 500)
    assert lang == "en" and 0 < confidence <= 1 and words == 5500


def exact(model, words):
    """Cosines with all centroids by the definition, from one bag of n-grams."""
    bag = Counter(g for w in words for g in language.grams(w))
    weight = {g: k * (model.idf[model.column[g]] if g in model.column else model.unseen) for g, k in bag.items()}
    length = sum(x * x for x in weight.values()) ** 0.5
    return max(sum(c[model.column[g]] * x for g, x in weight.items() if g in model.column) for c in model.centroids) / length


def test_cosines_are_exact_at_any_length(samples):
    model = language.Model(samples)
    for text in ("zqx " * 5, "zqx " * 200, "los fans esperaron la cancion zqx " * 7, "qwrtz plmk", "before the show " + "xyzzyq " * 30):
        words = language.content_words(text)
        lang, cosine, _ = model.classify(words)
        assert cosine == pytest.approx(exact(model, words)) and (lang < 0) == (cosine < language.REJECT)
    assert model.classify(["zqx"] * 5)[0] == model.classify(["zqx"] * 2000)[0] == -1


def test_long_words_are_scored_whole(samples):
    model = language.Model(samples)
    a, b = model.word("w" * 40 + "straße"), model.word("w" * 40 + "canción")
    assert (a[0] != b[0]).any()


def test_order_of_samples_does_not_matter(samples):
    a, b = language.Model(samples), language.Model(list(reversed(samples)) + samples)
    assert (a.centroids == b.centroids).all()


def test_frames(spark, samples):
    s = spark.createDataFrame(samples, "lang string, text string")
    df = spark.createDataFrame([(1, "los fans esperaron la canción en la estación", "x"), (2, None, "y")], "id int, t string, lang string")
    got = {r.id: r for r in language.detect(df, "t", s).collect()}
    assert got[1].segments[0].lang == "es" and got[2].segments == [] and got[1].lang == "x"
    events = spark.createDataFrame([(1, "los fans esperaron la canción en la estación", "spa"), (2, "los fans esperaron la canción en la estación", "fr"), (3, None, None)], "event_id bigint, cleaned_text string, lang string")
    records = spark.createDataFrame([(9, "los fans esperaron la canción en la estación")], "record_id bigint, text_normalized string")
    assert {(r.source_table, r.row_id, r.segment_no, r.lang) for r in language.unlabelled(events, records, s).collect()} == {("graph_events", 2, 1, "es"), ("normalized_records", 9, 1, "es")}
    assert language.detect(df.limit(0), "t", s).count() == 0


@pytest.mark.parametrize("text", ["z" * 300_000, "9" * 300_000, "a.b" * 100_000, '"' * 100_001, "x" + " " * 200_000 + "y"])
def test_long_runs_take_linear_time(samples, text):
    import time

    model = language.Model(samples)
    began = time.process_time()
    language.describe(model, text)
    assert time.process_time() - began < 20
