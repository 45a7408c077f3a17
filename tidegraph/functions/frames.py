"""Carrying a table's own columns past working columns of any name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegraph.session import written

ROW = "_row"


def carry(df: DataFrame, **needed: Column | str) -> DataFrame:
    """All columns of ``df`` as one struct, and beside it only the ones named: no working column can clash with the table's."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW), *[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in needed.items()])


def restore(carried: DataFrame, df: DataFrame, *made: str) -> DataFrame:
    """The columns of ``df`` again, then the made ones; a column of the table with a made one's name is replaced."""
    return carried.select(*[F.col(f"{ROW}.`{c}`").alias(c) for c in df.columns if c not in made], *made)


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``df`` with ``out``, the place of each row (from 0) in a total order.

    Rows are put in ranges of the whole order, as many as shuffles have partitions, and counted; a row's number is that of the
    ranges before plus its place within. So neither all rows nor those of one leading value are sorted by one task.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy().orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_place", place).join(sums.select("_range", before.alias("_before")), "_range").withColumn(out, (F.col("_place") + F.col("_before")).cast("bigint")).drop("_range", "_place", "_before")
