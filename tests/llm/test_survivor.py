from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidegraph.llm import survivor

SCHEMA = "tweet_id string, likes bigint, text_raw string, views bigint, record_status string, collected_at timestamp, source_file string, source_row_number bigint, post string, n int"
DAY = lambda n: datetime(2020, 1, n, tzinfo=timezone.utc)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "own", 7) for r in rows], SCHEMA)


@pytest.mark.parametrize("raw, want", [("1000", "1000"), (" '1000 ", "1000"), ("#1000\n", "1000"), ("۱۰۰۰", "1000"), ("１０００", "1000"), ("1.0e+18", None), ("1e18", None), ("100.0", None), ("", None), ("abc", None), (None, None), ("1٫5", None)])
def test_post_key(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(survivor.post_key(F.col("x"))).first()[0] == want


def test_order_of_rows(spark):
    rows = [
        ("1", 1, " ", None, "rejected", DAY(9), "a", 1), ("1", 2, "x", None, " Retained", DAY(1), "b", 1), ("1", 3, "y", None, "retained", DAY(2), "c", 1), ("'1", None, "z", None, "RETAINED ", None, "a", 9),
        ("2", 5, None, 7, None, None, "b", 2), ("2", 6, None, 8, None, None, "b", 1), ("2", 6, None, 8, None, None, "b", 1), ("3", 1, "q", 1, "retained", DAY(1), "a", 1), (None, 1, "q", 1, "retained", DAY(1), "a", 1),
    ]
    got = {(r.tweet_id, r.field_name): (r.canonical_source_file, r.canonical_source_row_number) for r in survivor.best_locations(frame(spark, rows)).collect()}
    assert got == {("1", "likes"): ("c", 1), ("1", "text_raw"): ("c", 1), ("2", "likes"): ("b", 1), ("2", "views"): ("b", 1)}


def test_votes_outweigh(spark):
    rows = [("1", 1, "x", None, "retained", DAY(1), "a", 1)] + [("1", 2, " x ", 4, "excluded", DAY(1), "a", i) for i in (2, 3, 4)] + [("2", None, None, None, None, None, "a", 9)]
    got = {r.tweet_id: r for r in survivor.consolidate(frame(spark, rows)).collect()}
    assert (got["1"].likes, got["1"].text_raw, got["1"].views, got["1"].occurrences) == (2, "x", 4, 4)
    assert (got["2"].likes, got["2"].text_raw, got["2"].occurrences) == (None, None, 1)


def test_ties_long_and_empty(spark):
    rows = [("1", i, "t" * 100_000 if i else "s", None, "retained", DAY(1), "a", i) for i in range(2)]
    got = survivor.consolidate(frame(spark, rows)).first()
    assert got.likes == 0 and got.text_raw == "s"
    e = frame(spark, rows).limit(0)
    assert survivor.best_locations(e).count() == 0 and survivor.consolidate(e).count() == 0


def test_hot_post(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.lit("7")).otherwise(F.col("id").cast("string")).alias("tweet_id"), F.col("id").alias("likes"), F.lit("t").alias("text_raw"), F.lit(None).cast("bigint").alias("views"), F.lit("retained").alias("record_status"), F.lit(None).cast("timestamp").alias("collected_at"), F.lit("f").alias("source_file"), F.col("id").alias("source_row_number"))
    assert {(r.field_name, r.canonical_source_row_number) for r in survivor.best_locations(df).where("tweet_id = '7'").collect()} == {("likes", 0), ("text_raw", 0)}
