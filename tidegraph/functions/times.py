"""Times, quarters and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.config import DEFAULT, Config
from tidegraph.functions.text import strip

MAX_SECONDS = 1_000_000_000_000


def strict_iso(c: Column) -> Column:
    """A time written YYYY-MM-DDTHH:MM:SS+00:00, as TIMESTAMP_NTZ in UTC; NULL for everything else."""
    form = c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\+00:00$")
    return F.when(form, F.concat_ws(" ", F.substring(c, 1, 10), F.substring(c, 12, 8)).try_cast("timestamp_ntz"))


def epoch_seconds(c: Column) -> Column:
    """Seconds of an epoch number in text, milliseconds above 10**12; NULL if it is no number."""
    s = strip(c.cast("string"))
    v = F.when(s.rlike(r"^[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$"), s.try_cast("double"))
    return F.when(F.abs(v) > MAX_SECONDS, v / 1000).otherwise(v).cast("bigint")


def created_at(c: Column, config: Config = DEFAULT) -> Column:
    """An epoch time as TIMESTAMP_NTZ within [earliest, latest]; NULL outside and for what is no number."""
    t = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.call_function("make_dt_interval", F.lit(0), F.lit(0), F.lit(0), F.when(F.abs(epoch_seconds(c)) < 10**11, epoch_seconds(c)))
    return F.when((t >= F.lit(f"{config.earliest} 00:00:00").cast("timestamp_ntz")) & (t <= F.lit(f"{config.latest} 23:59:59").cast("timestamp_ntz")), t)


def quarter_label(t: Column) -> Column:
    return F.concat(F.year(t), F.lit("-Q"), F.quarter(t))


def snapshot(t: Column, config: Config = DEFAULT) -> Column:
    """Number of the quarter of a time from the calendar's first; NULL outside the calendar."""
    n = F.year(t) * 4 + F.quarter(t) - 1 - config.first_index
    return F.when(n.between(0, config.snapshots - 1), n).cast("int")


def time_reason(c: Column, config: Config = DEFAULT) -> Column:
    """What a raw epoch time is: MISSING, CORRUPT, UNPARSABLE, EPOCH_OUTLIER, OUT_OF_RANGE_BEFORE, OUT_OF_RANGE_AFTER or IN_RANGE."""
    s = strip(c.cast("string"))
    t = created_at(c, config)
    n = F.year(t) * 4 + F.quarter(t) - 1 - config.first_index
    return (
        F.when(s.isNull() | (s == ""), "MISSING")
        .when(F.lower(s).rlike(r"^[+-]?(?:nan|inf|infinity)$"), "CORRUPT")
        .when(epoch_seconds(c).isNull(), "UNPARSABLE")
        .when(t.isNull(), "EPOCH_OUTLIER")
        .when(n < 0, "OUT_OF_RANGE_BEFORE")
        .when(n >= config.snapshots, "OUT_OF_RANGE_AFTER")
        .otherwise("IN_RANGE")
    )


def profile_epoch(c: Column) -> Column:
    """An epoch time for profiles: between 10**9 and 2100, both left out; NULL outside."""
    v = epoch_seconds(c)
    return F.when((v > 1_000_000_000) & (v < 4_102_444_800), v)


def calendar(spark: SparkSession, config: Config = DEFAULT) -> DataFrame:
    """One row per quarter: snapshot_id, label, start (inclusive) and end (exclusive), dates in UTC."""
    year, q = divmod(config.first_index, 4)
    first = f"{year}-{q * 3 + 1:02d}-01"
    start = F.add_months(F.lit(first).cast("date"), (F.col("id") * 3).cast("int"))
    return spark.range(config.snapshots).select(
        F.col("id").cast("int").alias("snapshot_id"), F.concat(F.year(start), F.lit("-Q"), F.quarter(start)).alias("label"), start.alias("start"), F.add_months(start, 3).alias("end")
    )
