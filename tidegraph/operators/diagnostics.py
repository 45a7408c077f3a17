"""Calendar, length and coverage reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegraph.config import DEFAULT, Config
from tidegraph.functions.text import SPACE, is_blank


def calendar_report(rows: DataFrame, quarters: DataFrame, nodes: str = "node_index") -> DataFrame:
    """Per quarter of the calendar, empty ones too: rows, distinct nodes, first and last epoch second.

    ``rows``: snapshot_id, ``nodes`` and created (TIMESTAMP_NTZ).
    """
    seconds = F.unix_seconds(F.col("created").cast("timestamp"))
    states = rows.where("snapshot_id is not null").groupBy("snapshot_id", nodes).agg(F.count(F.lit(1)).alias("n"), F.min(seconds).alias("lo"), F.max(seconds).alias("hi"))
    got = states.groupBy("snapshot_id").agg(F.sum("n").alias("rows"), F.count(nodes).alias("nodes"), F.min("lo").alias("first_epoch"), F.max("hi").alias("last_epoch"))
    return quarters.select("snapshot_id", "label").join(got, "snapshot_id", "left").fillna(0, ["rows", "nodes"])


def empty_quarters(report: DataFrame) -> DataFrame:
    """The empty quarters of a calendar report and where they lie: leading, internal or trailing; all leading if none has rows."""
    full = F.col("rows") > 0
    before = F.max(full).over(W.partitionBy().orderBy("snapshot_id").rowsBetween(W.unboundedPreceding, W.currentRow))
    after = F.max(full).over(W.partitionBy().orderBy("snapshot_id").rowsBetween(W.currentRow, W.unboundedFollowing))
    kind = F.when(~F.col("before"), "leading").when(~F.col("after"), "trailing").otherwise("internal")
    return report.withColumns({"before": before, "after": after}).where("rows = 0").select("snapshot_id", "label", kind.alias("position"))


def reason_counts(rows: DataFrame, reason: Column) -> DataFrame:
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


def text_class(c: Column) -> Column:
    """null, empty, whitespace_only or ok."""
    return F.when(c.isNull(), "null").when(c == "", "empty").when(is_blank(c), "whitespace_only").otherwise("ok")


def whitespace_tokens(c: Column) -> Column:
    """Runs of anything but white space."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), rf"(?U){SPACE}+"), lambda x: x != ""))


def length_summary(df: DataFrame, text: str, by: list[str], config: Config = DEFAULT) -> DataFrame:
    """Exact quantiles of text lengths and how many exceed each candidate limit, per group.

    Lengths are counted first, so a group's quantiles come from one row per length however many texts it has.
    """
    n = F.length(text)
    counted = df.where(F.col(text).isNotNull()).groupBy(*by, n.alias("len")).agg(F.count(F.lit(1)).alias("f"))
    q = F.percentile("len", F.array(*[F.lit(x) for x in config.quantiles]), F.col("f"))
    wide = counted.groupBy(*by).agg(
        F.sum("f").alias("texts"),
        F.max("len").alias("longest"),
        q.alias("_q"),
        *[F.sum(F.when(F.col("len") > m, F.col("f")).otherwise(0)).alias(f"above_{m}") for m in config.max_lengths],
    )
    names = [f"p{str(x * 100).rstrip('0').rstrip('.').replace('.', '_')}" for x in config.quantiles]
    return wide.select(*by, "texts", "longest", *[F.round(F.col("_q")[i], 6).alias(name) for i, name in enumerate(names)], *[f"above_{m}" for m in config.max_lengths])


def text_class_counts(df: DataFrame, text: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by, text_class(F.col(text)).alias("text_class")).agg(F.count(F.lit(1)).alias("rows"))


def nearest_rank(df: DataFrame, value: str, shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Values at the places round((n - 1) p), halves to the even place: value counts, then a running count."""
    counted = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("f"))
    running = counted.withColumn("upto", F.sum("f").over(W.partitionBy().orderBy(value)))
    n = counted.agg(F.sum("f")).scalar()
    places = F.array(*[F.struct(F.lit(x).alias("share"), F.bround((F.col("_n") - 1) * F.lit(x), 0).cast("bigint").alias("place")) for x in shares])
    here = F.filter(places, lambda p: (p["place"] < F.col("upto")) & (p["place"] >= F.col("upto") - F.col("f")))
    return running.withColumn("_n", n).select(F.explode(here).alias("p"), F.col(value).alias("value")).select(F.col("p.share").alias("share"), "value")


def coverage_reason(relations: int = 4) -> Column:
    """Why a row does not count for coverage, first reason first: missing_fields, invalid_relation, outside_universe, self_loop; else accepted."""
    return (
        F.when(F.col("author_account_id").isNull() | F.col("created").isNull() | F.col("relation_id").isNull(), "missing_fields")
        .when(~F.col("relation_id").between(0, relations - 1), "invalid_relation")
        .when(F.col("source_idx").isNull(), "outside_universe")
        .when(F.coalesce(F.col("source_idx") == F.col("target_idx"), F.lit(False)) | (F.col("target_idx").isNull() & F.coalesce(F.col("author_account_id") == F.col("target_account_id"), F.lit(False))), "self_loop")
        .otherwise("accepted")
    )


def coverage_by_snapshot(struct_nodes: DataFrame, text_nodes: DataFrame, quarters: DataFrame, universe: int) -> DataFrame:
    """Per quarter: nodes with structure only, text only, both; active nodes and their share of the universe.

    Both inputs: snapshot_id and node_index, repeated or not.
    """
    flags = (
        struct_nodes.select("snapshot_id", "node_index", F.lit(True).alias("s"), F.lit(False).alias("t"))
        .unionByName(text_nodes.select("snapshot_id", "node_index", F.lit(False).alias("s"), F.lit(True).alias("t")))
        .where("snapshot_id is not null and node_index is not null")
        .groupBy("snapshot_id", "node_index")
        .agg(F.bool_or("s").alias("s"), F.bool_or("t").alias("t"))
    )
    got = flags.groupBy("snapshot_id").agg(
        F.count_if(F.col("s") & ~F.col("t")).alias("structure_only"), F.count_if(~F.col("s") & F.col("t")).alias("text_only"), F.count_if(F.col("s") & F.col("t")).alias("both"), F.count(F.lit(1)).alias("active")
    )
    return (
        quarters.select("snapshot_id", "label").join(got, "snapshot_id", "left").fillna(0, ["structure_only", "text_only", "both", "active"]).withColumn("active_share", F.round(F.col("active") / F.lit(max(universe, 1)), 6))
    )


def empty_relations(edge: DataFrame, quarters: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Quarters and relations without an edge."""
    grid = quarters.select("snapshot_id", F.explode(F.array(*[F.lit(i) for i in range(len(config.relations))])).alias("relation_id"))
    return grid.join(edge.select("snapshot_id", F.col("relation_id").cast("int")).distinct(), ["snapshot_id", "relation_id"], "left_anti")


def text_coverage(events: DataFrame) -> DataFrame:
    """Events and those with text, by snapshot, by relation and by both, in one pass over grouping sets; NULL is 'all'."""
    states = events.groupBy("snapshot_id", "relation_id").agg(F.count(F.lit(1)).alias("events"), F.count_if(~is_blank(F.col("cleaned_text"))).alias("with_text"))
    known = states.where("snapshot_id is not null and relation_id is not null").select("snapshot_id", F.col("relation_id").cast("int"), "events", "with_text")
    return (
        known.groupingSets([["snapshot_id"], ["relation_id"], ["snapshot_id", "relation_id"]], "snapshot_id", "relation_id")
        .agg(F.sum("events").alias("events"), F.sum("with_text").alias("with_text"))
        .withColumn("share", F.round(F.col("with_text") / F.col("events"), 6))
    )


def label_coverage(eligible: DataFrame, labels: DataFrame) -> DataFrame:
    """Per snapshot: nodes eligible for evaluation, those with a label and their share, and those eligible and labelled also in the snapshot before.

    ``eligible`` and ``labels``: snapshot_id and node_index, repeated or not; labels of nodes that are not eligible do not count.
    """
    e = eligible.select("snapshot_id", "node_index").where("snapshot_id is not null and node_index is not null").distinct()
    both = e.join(labels.select("snapshot_id", "node_index").distinct().withColumn("l", F.lit(1)), ["snapshot_id", "node_index"], "left")
    before = both.where("l is not null").select((F.col("snapshot_id") + 1).alias("snapshot_id"), "node_index", F.lit(1).alias("p"))
    joined = both.join(before, ["snapshot_id", "node_index"], "left")
    return joined.groupBy("snapshot_id").agg(
        F.count(F.lit(1)).alias("eligible"), F.count("l").alias("labelled"), F.round(F.count("l") / F.count(F.lit(1)), 6).alias("share"), F.count_if(F.col("l").isNotNull() & F.col("p").isNotNull()).alias("pairs")
    )
