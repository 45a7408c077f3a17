"""Mixing sources to target shares of the tokens (problem 9).

Weighted fair queueing: within each source the texts stand in a hashed order,
repeated as often as the source allows; a text's virtual finish time is the
source's tokens up to its end divided by the source's weight. Taken in order of
finish time, all sources advance at their target pace, and the mix ends where
its total reaches the budget.

Both running totals (of a source, and of the mix) are two-step prefix sums over
ranges of the order: sums per range first, then rows within a range. No range
holds more than a bounded number of rows on average, so a source with most of
the texts is many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegraph.functions.text import strip
from tidegraph.session import written

RANGE_ROWS = 50_000
SEED = 9
MAX_SOURCES = 10_000
#: 2 ** 53: the hashed order is a whole number below it.
_STEPS = 9007199254740992


def source_name(c: Column) -> Column:
    """A source's name without case, surrounding white space and differing separators; blank means none."""
    return F.nullif(F.regexp_replace(F.lower(strip(c)), r"[\s\-_]+", "_"), F.lit(""))


def running_total(df: DataFrame, keys: list[str], bucket: str, order: list, value: str, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` up to and including each row, over ``keys`` in order of bucket, then ``order``.

    ``bucket`` cuts the order into ranges that one task can hold.
    """
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(*keys, bucket, before.alias("_before"))
    within = F.sum(value).over(W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn(out, within).join(offsets, [*keys, bucket]).withColumn(out, F.col(out) + F.col("_before")).drop("_before")


def candidates(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", tokens: str = "tokens") -> DataFrame:
    """One row per distinct text with tokens in a source with a target: key, source, tokens, weight, repeats.

    A text on several rows is one candidate, under its smallest key, so it cannot
    be used more often by being copied. Weights are the target shares over
    the sources that have texts at all.
    """
    wanted = targets.where("target_share > 0 and max_repeats > 0").groupBy(source_name(F.col("source")).alias("source")).agg(
        F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")
    )
    one = (
        docs.select(F.col(key).alias("key"), source_name(F.col(source)).alias("source"), F.col(tokens).alias("tokens"), F.sha2(F.col(text), 256).alias("_h"))
        .where("tokens > 0 and source is not null")
        .groupBy("_h")
        .agg(F.min(F.struct("key", "source", "tokens")).alias("s"))
        .select("s.*")
    )
    if wanted.limit(MAX_SOURCES + 1).count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources with a target")
    return one.join(F.broadcast(wanted), "source")


def horizon(sources: list[tuple[float, float, int]], budget: int) -> float:
    """A finish time no text of the mix exceeds, from (weight, tokens with all repeats, longest text) of each source.

    By the finish time f a source has given at least weight * f less one text, or all it has. The
    horizon is the time at which that comes to more than the budget; if all
    sources together hold no more, it is the finish time of the very last copy.
    """
    end = max((held / weight for weight, held, _ in sources), default=1.0)
    given = lambda f: sum(held if weight * f >= held else max(0.0, weight * f - longest) for weight, held, longest in sources)
    slack = 1 + 1e-9  # for rounding; what it lets through is cut by the budget
    if given(end) <= budget:
        return end * slack
    low, high = 0.0, end
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (low, middle) if given(middle) > budget else (middle, high)
    return high * slack


def mix(docs: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The mix in order: position (tokens before), key, source, copy (from 1), tokens.

    ``budget`` is the total in tokens; without it, the largest total at which every source
    that has texts can still reach its share. The mix is the longest run in order of
    finish time whose total does not exceed the budget. NULL texts, texts without
    tokens and sources without a target take no part; an empty table gives an empty mix.
    """
    pool = written(candidates(docs, targets), "pool")
    size = pool.groupBy("source", "share", "repeats").agg(F.sum("tokens").alias("total"), F.count(F.lit(1)).alias("n"), F.max("tokens").alias("longest"))
    own = size.agg(F.sum("share").alias("shares"), F.sum("n").alias("n"), F.sum("total").alias("tokens"), F.sum(F.col("total") * F.col("repeats")).alias("all_copies")).first()
    pool = pool.withColumn("weight", F.col("share") / F.lit(own.shares or 1.0))
    if budget is None:
        reach = size.agg(F.min(F.floor(F.col("total") * F.col("repeats") / (F.col("share") / F.lit(own.shares or 1.0))))).first()[0]
        budget = int(reach or 0)
    end = horizon([(r.share / (own.shares or 1.0), float(r.total) * r.repeats, r.longest) for r in size.collect()], budget)
    rank = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(_STEPS))
    ranges = max(1, -(-(own.n or 0) // range_rows))
    placed = pool.withColumn("_rank", rank).withColumn("_range", F.floor(F.col("_rank") * F.lit(ranges) / F.lit(_STEPS)).cast("bigint"))
    placed = running_total(placed, ["source"], "_range", ["_rank", "key"], "tokens", "_end")
    # copies that finish after the end of the mix are never made
    last = F.least(F.col("repeats").cast("double"), F.floor((F.lit(end) * F.col("weight") - F.col("_end")) / F.col("total")) + 1).cast("int")
    copies = placed.join(F.broadcast(size.select("source", "total")), "source").withColumn("_last", last).where("_last >= 1").select(
        "key", "source", "tokens", "weight", "_end", "total", F.explode(F.sequence(F.lit(1), F.col("_last"))).alias("copy")
    )
    finish = (F.col("_end") + (F.col("copy") - 1) * F.col("total")) / F.col("weight")
    # up to the end all sources advance together, so slots of equal length hold about equally many tokens
    mean = (own.tokens or 1) / (own.n or 1)
    slots = max(1, math.ceil(min(end, own.all_copies or 1) / mean / range_rows))
    queued = copies.withColumn("finish", finish).withColumn("_slot", F.least(F.floor(F.col("finish") / F.lit(end) * F.lit(slots)).cast("bigint"), F.lit(slots - 1)))
    ordered = running_total(queued, [], "_slot", ["finish", "source", "key", "copy"], "tokens", "_total")
    return ordered.where(F.col("_total") <= budget).select((F.col("_total") - F.col("tokens")).alias("position"), F.col("key").alias("doc_id"), "source", "copy", "tokens")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source with a target: target_share, actual_share, tokens, uses, texts, most_uses; zeros for absent sources."""
    per_text = mixed.groupBy("source", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"))
    got = per_text.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("uses").alias("uses"), F.count(F.lit(1)).alias("texts"), F.max("uses").alias("most_uses"))
    total = F.sum("tokens").over(W.partitionBy())
    wanted = targets.select(source_name(F.col("source")).alias("source"), "target_share")
    filled = wanted.join(got, "source", "left").fillna(0, ["tokens", "uses", "texts", "most_uses"])
    return filled.withColumn("actual_share", F.round(F.when(total > 0, F.col("tokens") / total).otherwise(0.0), 6))
