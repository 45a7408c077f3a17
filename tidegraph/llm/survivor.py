"""Best representative of each group of duplicate records (problem 5).

Records are unpivoted to one long row per field, every long row votes for its
normalised value, votes are summed per value, the value with the most is chosen by
``max_by`` and the fields are pivoted back to one record per post. All aggregations combine
on the map side, so a post on a third of all rows is no hot task.

A vote is trust in the record's status times a decay by the time of collection.
``best_locations`` wants a strict order instead (status, then latest collection, then
smallest source location). Sums alone cannot express it, as many poor rows would outvote one
good row, so there the votes of a value are led by the key of its best occurrence and
the sum only follows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.frames import carry, restore
from tidegraph.functions.text import ascii_digits, is_blank, strip

#: Trust by status, best first; records of no known status get the last value.
STATUS_ORDER = ("retained", "excluded", "rejected")
TRUST = (1.0, 0.5, 0.25, 0.125)
FIELDS = ("likes", "text_raw", "views")
AS_OF = "2026-07-01 00:00:00"
HALF_LIFE = 365.0
#: The place in time of records without a collection time: after all others.
NEVER = 2**63 - 1


def post_key(tweet_id: Column) -> Column:
    """The ASCII digits of a post id; NULL if it has none, a decimal point or an exponent."""
    s = ascii_digits(tweet_id)
    digits = F.regexp_replace(s, "[^0-9]", "")
    broken = s.rlike(r"[0-9]\s*[.٫．]|[.٫．]\s*[0-9]|[0-9]\s*[eE]\s*[+-]?\s*[0-9]")
    return F.when((digits != "") & ~broken, digits)


def status_rank(status: Column) -> Column:
    """0 retained, 1 excluded, 2 rejected, 3 anything else; case and blanks around are ignored."""
    s = F.lower(strip(status))
    return F.when(s == STATUS_ORDER[0], 0).when(s == STATUS_ORDER[1], 1).when(s == STATUS_ORDER[2], 2).otherwise(3)


def _present(df: DataFrame, field: str) -> Column:
    c = F.col(f"`{field}`")
    return ~is_blank(c) if dict(df.dtypes)[field] == "string" else c.isNotNull()


def normalised(c: Column) -> Column:
    """What values are compared by: their text without white space around."""
    return strip(c.cast("string"))


def vote(half_life_days: float, as_of: str) -> Column:
    """Trust by status times 0.5 ** (age at ``as_of`` / ``half_life_days``); no collection time is an age of ten half-lives."""
    late = F.col("late")
    age = F.when(late == NEVER, F.lit(10.0 * half_life_days)).otherwise((F.lit(as_of).cast("timestamp").cast("double") + late.cast("double") / 1e6) / 86400.0)
    return F.element_at(F.array(*[F.lit(t) for t in TRUST]), F.col("status") + 1) * F.pow(F.lit(0.5), age / half_life_days)


def long_rows(records: DataFrame, fields: Sequence[str], value: Callable[[str], Column]) -> DataFrame:
    """One row per record and field: post, field_name, value (NULL if missing), status and late (negated time of collection), source location."""
    per_field = [F.struct(F.lit(f).alias("field_name"), F.when(_present(records, f), value(f)).alias("value")) for f in fields]
    late = F.coalesce(-F.unix_micros(F.col("collected_at").cast("timestamp")), F.lit(NEVER))
    return (
        records.select(
            post_key(F.col("tweet_id")).alias("post"),
            status_rank(F.col("record_status")).alias("status"),
            late.alias("late"),
            "source_file",
            "source_row_number",
            F.explode(F.array(*per_field)).alias("f"),
        )
        .where(F.col("post").isNotNull())
        .select("post", "f.*", "status", "late", "source_file", "source_row_number")
    )


def best_locations(records: DataFrame, fields: Sequence[str] = FIELDS, half_life_days: float = HALF_LIFE, as_of: str = AS_OF) -> DataFrame:
    """For each post on two or more rows and each field, the row that supplies its value.

    No row comes out for a field without any value. Ties end at the smallest
    (source_file, source_row_number). Records that name no post are left out. Values
    are told apart by the hash of their normalised text, which saves moving texts.
    """
    # the least key is the best row, so a value's lead is the least of its rows
    key = F.struct("status", "late", "source_file", "source_row_number")
    tally = (
        long_rows(records, fields, lambda f: F.xxhash64(normalised(F.col(f))))
        .groupBy("post", "field_name", "value")
        .agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lead"), F.sum(vote(half_life_days, as_of)).alias("votes"))
    )
    # the strongest vote is the one with the least key, as texts (of locations) have no negative: min_by is max_by in that order
    strength = F.when(F.col("value").isNotNull(), F.struct("lead", (-F.col("votes")).alias("votes")))
    won = tally.groupBy("post", "field_name").agg(F.sum("n").alias("n"), F.min_by("lead", strength).alias("best"))
    record = won.where("n >= 2 and best is not null").groupBy("post").agg(*[F.max(F.when(F.col("field_name") == f, F.col("best"))).alias(f) for f in fields])
    rows = F.filter(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("at")) for f in fields]), lambda x: x["at"].isNotNull())
    return record.select(F.col("post").alias("tweet_id"), F.explode(rows).alias("r")).select(
        "tweet_id",
        "r.field_name",
        F.col("r.at.source_file").alias("canonical_source_file"),
        F.col("r.at.source_row_number").alias("canonical_source_row_number"),
    )


def data_columns(records: DataFrame) -> list[str]:
    """Every column that can be voted on: all but the post id, which is the key."""
    return [c for c in records.columns if c != "tweet_id"]


def consolidate(records: DataFrame, fields: Sequence[str] | None = None, half_life_days: float = HALF_LIFE, as_of: str = AS_OF) -> DataFrame:
    """One record per post with the value of most votes in every field (all columns by default).

    Values are compared as text without white space around, the winner is the
    smallest such text among those with equal votes (to nine digits). Posts on one row
    come out too; that row is its own best and casts no votes. ``occurrences`` is the number of rows of the post.
    """
    fields = [f for f in (data_columns(records) if fields is None else fields) if f != "occurrences"]
    kinds = dict(records.dtypes)
    keyed = carry(records, _post=post_key(F.col("tweet_id"))).where("_post is not null")
    counts = keyed.groupBy("_post").agg(F.count(F.lit(1)).alias("_rows"))
    alone = keyed.join(counts.where("_rows = 1").select("_post"), "_post", "left_semi")
    several = restore(keyed.join(counts.where("_rows > 1").select("_post"), "_post", "left_semi"), records)
    own = restore(alone.select("_row"), records)
    single = own.select(
        post_key(F.col("tweet_id")).alias("_post"), F.lit(1).cast("bigint").alias("_n"), *[F.when(_present(records, f), normalised(F.col(f"`{f}`"))).alias(f"_{i}") for i, f in enumerate(fields)]
    )
    tally = (
        long_rows(several, fields, lambda f: normalised(F.col(f"`{f}`")))
        .groupBy("post", "field_name", "value")
        .agg(F.sum(F.when(F.col("value").isNotNull(), vote(half_life_days, as_of))).alias("votes"), F.count(F.lit(1)).alias("n"))
    )
    # of equal votes the smallest text wins: min_by over the negated sum is max_by over the sum
    strength = F.when(F.col("value").isNotNull(), F.struct((-F.round("votes", 9)).alias("v"), F.col("value").alias("x")))
    won = tally.groupBy("post", "field_name").agg(F.min_by("value", strength).alias("best"), F.sum("n").alias("n"))
    voted = won.groupBy(F.col("post").alias("_post")).agg(F.max("n").alias("_n"), *[F.max(F.when(F.col("field_name") == f, F.col("best"))).alias(f"_{i}") for i, f in enumerate(fields)])
    return single.unionByName(voted).select(F.col("_post").alias("tweet_id"), F.col("_n").alias("occurrences"), *[F.col(f"_{i}").cast(kinds[f]).alias(f) for i, f in enumerate(fields)])
