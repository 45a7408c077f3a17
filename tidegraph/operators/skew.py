"""Per-key results where a few keys hold most rows (problem 7).

Eager aggregation: both inputs of a join are reduced to one compact state per
join key before they meet, the states are joined, and counts are multiplied
and sums scaled. No task ever holds the rows of a hot key: the first
aggregation combines them on the map side, and what is shuffled is at most one
state per key and map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.text import strip

RELATIONS = ("mention", "retweet", "reply", "quote")


def account_key(c: Column) -> Column:
    """An account id without surrounding white space; blank means none."""
    return F.nullif(strip(c.cast("string")), F.lit(""))


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_sums: Sequence[str] = (),
    right_sums: Sequence[str] = (),
    by: str | None = None,
) -> DataFrame:
    """Counts and sums over the inner join of two tables on ``key``, without building it.

    ``left_rows * right_rows`` rows would be joined for a key; here each side is
    first reduced to (count, sums) per key. ``rows`` is the number of joined rows,
    ``sum_<c>`` the sum of a column over them. ``by`` names a column of ``right``
    to roll up to; without it there is one row per key.

    NULL keys join nothing, NULL values count as nothing in sums, empty inputs
    give no rows. Repeated rows count as often as they occur. Columns of the
    same name on both sides do not clash as only the named ones are read.
    """
    low = left.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k_")).agg(
        F.count(F.lit(1)).alias("nl_"), *[F.sum(c).alias(f"l_{c}") for c in left_sums]
    )
    keys = [F.col(key).alias("k_")] + ([F.col(by).alias("by_")] if by else [])
    high = right.where(F.col(key).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("nr_"), *[F.sum(c).alias(f"r_{c}") for c in right_sums]
    )
    out = "by_" if by else "k_"
    return (
        low.join(high, "k_")
        .groupBy(F.col(out).alias(by or key))
        .agg(
            F.sum(F.col("nl_") * F.col("nr_")).alias("rows"),
            *[F.sum(F.col(f"l_{c}") * F.col("nr_")).alias(f"sum_{c}") for c in left_sums],
            *[F.sum(F.col(f"r_{c}") * F.col("nl_")).alias(f"sum_{c}") for c in right_sums],
        )
    )


def _side(pairs: DataFrame, me: str, other: str, prefix: str) -> DataFrame:
    """The compact state of each account on one side of the pairs: events, counterparts and events per relation."""
    sums = [F.sum("n").alias("events"), F.count(other).alias("counterparts"), *[F.sum(r).alias(r) for r in RELATIONS]]
    one = pairs.where(F.col(me).isNotNull()).groupBy(F.col(me).alias("account_id")).agg(*sums)
    return one.select("account_id", *[F.col(c).alias(f"{prefix}_{c}") for c in one.columns if c != "account_id"])


def account_states(events: DataFrame) -> DataFrame:
    """One row per role and account: events, distinct counterparts, events per relation.

    The rows an account wrote and those it received are two inputs with the account as their
    key. Both are reduced before they meet: first to one state per (author, target), so that distinct
    counterparts become a plain count and an account in a third of all rows is spread over all
    tasks by its counterparts, then to one state per account. The states are joined, one row for
    each account, and rolled up to roles. Rows without an account in a role give nothing in
    that role; a missing counterpart counts as an event but not as a counterpart.
    """
    relation = F.col("relation_id")
    pairs = (
        events.select(account_key(F.col("author_account_id")).alias("a"), account_key(F.col("target_account_id")).alias("t"), "relation_id")
        .groupBy("a", "t")
        .agg(F.count(F.lit(1)).alias("n"), *[F.count_if(relation == i).alias(r) for i, r in enumerate(RELATIONS)])
    )
    joined = _side(pairs, "a", "t", "author").join(_side(pairs, "t", "a", "target"), "account_id", "full")
    fields = ("events", "counterparts", *RELATIONS)
    roles = F.array(*[F.struct(F.lit(role).alias("role"), *[F.col(f"{role}_{f}").alias(f) for f in fields]) for role in ("author", "target")])
    return joined.select("account_id", F.explode(roles).alias("s")).where(F.col("s.events").isNotNull()).select("s.role", "account_id", *[f"s.{f}" for f in fields])


def account_profile(events: DataFrame, universe: DataFrame) -> DataFrame:
    """``account_states`` with the node index of each account (NULL outside the universe).

    The universe too is reduced to one row per account before the join, so
    repeated entries multiply nothing; the smallest index holds.
    """
    nodes = (
        universe.select(account_key(F.col("account_id")).alias("account_id"), "node_index")
        .groupBy("account_id")
        .agg(F.min("node_index").alias("node_index"))
    )
    return account_states(events).join(nodes, "account_id", "left").select(
        "role", "account_id", "node_index", "events", "counterparts", *RELATIONS
    )


def heavy_accounts(events: DataFrame, universe: DataFrame, percent: int = 1) -> DataFrame:
    """Accounts that are author or target of at least ``percent`` hundredths of all rows.

    All rows count, those without an account too. An empty table has no heavy accounts.
    """
    total = events.agg(F.count(F.lit(1)).alias("total")).scalar()
    return account_profile(events, universe).where(F.col("events") * 100 >= total * percent)
