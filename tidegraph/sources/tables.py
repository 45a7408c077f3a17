"""The tables of a directory, one Parquet file or folder each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegraph.session import spread

#: The tables that grow, and the columns by whose hash their rows are spread where a session asks for that.
GROWING = {"graph_events": ("event_id",), "normalized_records": ("record_id",), "dataset_b_raw": ("source_file", "source_row_number"), "documents": ("doc_id",)}


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name`` of ``directory``; columns and rows are pruned by the reader, also below a spreading of rows."""
    df = spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
    return spread(df, *GROWING[name]) if name in GROWING and set(GROWING[name]) <= set(df.columns) else df
