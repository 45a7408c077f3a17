from tidegraph.llm import queries, survivor


def test_every_column_is_voted_on(spark):
    schema = "tweet_id string, likes bigint, retweets bigint, text_normalized string, seen boolean, record_status string, collected_at timestamp, source_file string, source_row_number bigint"
    rows = [("1", 1, None, "x", True, "retained", None, "a", 1), ("'1", None, 5, " x ", True, "retained", None, "b", 2), ("1", 1, 6, "y", False, "rejected", None, "b", 3)]
    df = spark.createDataFrame(rows, schema)
    got = survivor.consolidate(df, survivor.data_columns(df)).collect()
    assert len(got) == 1
    assert got[0].asDict() == {"tweet_id": "1", "occurrences": 3, "likes": 1, "retweets": 5, "text_normalized": "x", "seen": True, "record_status": "retained", "collected_at": None, "source_file": "b", "source_row_number": 1}


def test_query_has_all_columns(spark, data):
    r = spark.read.parquet(f"{data}/normalized_records.parquet")
    got = queries.QUERIES["p5_consolidated"](spark, data)
    assert set(got.columns) == {*r.columns, "occurrences"} and len(got.columns) == 27
    assert {c: t for c, t in got.dtypes if c in r.columns} == dict(r.dtypes)
