"""From interaction rows to events, weighted edges and structural features."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegraph.config import DEFAULT, FEATURES, Config
from tidegraph.functions.frames import numbered
from tidegraph.functions.hashing import content_hash, event_signature
from tidegraph.functions.ids import mention_ids, nested_user_id, user_object
from tidegraph.functions.text import is_blank, normalized_text
from tidegraph.functions.times import created_at, snapshot
from tidegraph.operators.skew import account_key
from tidegraph.operators.timestamps import normalise_timestamps

EDGE = ["snapshot_id", "relation_id", "src_index", "dst_index"]


def node_map(accounts: DataFrame, column: str = "account_id") -> DataFrame:
    """account_id and a dense node_index from 0 in numeric order of the distinct ids.

    The index is a running count over ranges of the order, so no task sorts all ids.
    """
    ids = accounts.select(account_key(F.col(column)).alias("account_id")).where(F.col("account_id").rlike(r"^\d+$")).distinct()
    # the shorter number is the smaller one; leading zeros do not count
    plain = F.regexp_replace("account_id", "^0+(?=.)", "")
    ordered = ids.withColumns({"_digits": F.length(plain), "_plain": plain})
    return numbered(ordered, ["_digits", "_plain", "account_id"], "node_index").select("account_id", F.col("node_index").cast("int").alias("node_index"))


def sheet_interactions(rows: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Rows of a graph sheet to one row per relation target; rows without a target stay once, without a relation.

    The blobs of mentioned, retweeted, answered and quoted users are read for ids; a
    mention list gives one row per mention.
    """
    one = lambda relation, c: F.when(nested_user_id(F.col(c)).isNotNull(), F.array(F.struct(F.lit(relation).cast("tinyint").alias("relation_id"), nested_user_id(F.col(c)).alias("target_account_id")))).otherwise(F.array())
    mentions = F.transform(mention_ids(F.col("user_mentions")), lambda i: F.struct(F.lit(0).cast("tinyint").alias("relation_id"), i.alias("target_account_id")))
    targets = F.concat(mentions, one(1, "retweeted_status"), one(2, "reply_status"), one(3, "quoted_status"))
    t = created_at(F.col("created_at"), config)
    return (
        rows.withColumn("_t", F.explode_outer(targets))
        .withColumn("_user", user_object(F.col("user")))
        .select(
            "source_file",
            "source_row_number",
            F.col("_user.account_id").alias("author_account_id"),
            F.col("_t.target_account_id").alias("target_account_id"),
            F.col("_t.relation_id").alias("relation_id"),
            t.alias("created"),
            F.col("text").alias("cleaned_text"),
        )
    )


def event_interactions(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of the event table in the form of ``sheet_interactions``.

    Times may be written in any way ``normalise_timestamps`` reads, local ones in the zone
    that ``sources`` assumes for the file; texts get plain line ends and composed letters.
    """
    timed = normalise_timestamps(events.select("source_file", "source_row_number", "author_account_id", "target_account_id", "relation_id", "created_at_utc_iso", "cleaned_text", "signature"), sources)
    return normalized_text(timed, "cleaned_text", "cleaned_text").select(
        "source_file",
        "source_row_number",
        account_key(F.col("author_account_id")).alias("author_account_id"),
        account_key(F.col("target_account_id")).alias("target_account_id"),
        "relation_id",
        F.col("instant_utc").alias("created"),
        "cleaned_text",
        F.col("created_at_utc_iso").alias("created_text"),
        "signature",
    )


def indexed(interactions: DataFrame, nodes: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Interactions with source_idx, target_idx and snapshot_id; NULL where a node or quarter is unknown.

    The node map is one row per account; Spark broadcasts it when it is small.
    """
    src = nodes.select(F.col("account_id").alias("author_account_id"), F.col("node_index").alias("source_idx"))
    dst = nodes.select(F.col("account_id").alias("target_account_id"), F.col("node_index").alias("target_idx"))
    return interactions.join(src, "author_account_id", "left").join(dst, "target_account_id", "left").withColumn("snapshot_id", snapshot(F.col("created"), config))


def ladder(relations: int = 4) -> Column:
    """Why an indexed interaction is no event, first reason first; 'event' if it is one."""
    return (
        F.when(F.col("author_account_id").isNull(), "missing_author")
        .when(F.col("source_idx").isNull(), "author_outside_universe")
        .when(F.col("created").isNull(), "invalid_timestamp")
        .when(F.col("snapshot_id").isNull(), "outside_calendar")
        .when(F.col("target_account_id").isNull(), "no_relation_target")
        .when(~F.coalesce(F.col("relation_id").between(0, relations - 1), F.lit(False)), "invalid_relation")
        .when(F.col("target_account_id") == F.col("author_account_id"), "self_loop")
        .when(F.col("target_idx").isNull(), "external_target")
        .otherwise("event")
    )


def ladder_counts(interactions: DataFrame, nodes: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return indexed(interactions, nodes, config).groupBy(ladder().alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


def relation_events(interactions: DataFrame, nodes: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Events in the canonical schema; of rows with the same signature the first by file and row stays."""
    kept = indexed(interactions, nodes, config).where(ladder() == "event")
    signed = kept if "signature" in interactions.columns else kept.withColumn("signature", signature())
    columns = ["signature", "snapshot_id", "relation_id", "source_idx", "target_idx", "cleaned_text", short_hash().alias("text_hash"), event_quality().alias("text_quality"), "source_file", "source_row_number"]
    return first_wins(signed.select(*columns), ["signature"], ["source_file", "source_row_number"])


def event_quality(text: str = "cleaned_text") -> Column:
    """empty (also for NULL), whitespace_only or ok."""
    c = F.coalesce(F.col(text), F.lit(""))
    return F.when(c == "", "empty").when(is_blank(c), "whitespace_only").otherwise("ok")


def short_hash(text: str = "cleaned_text") -> Column:
    """The first 16 digits of the hash of an event's text; one without text has the hash of the empty text."""
    return content_hash(F.when(event_quality(text) == "ok", F.col(text)).otherwise(F.lit("")), 16)


def signature() -> Column:
    """The signature of an interaction with ``created``, in whole seconds."""
    iso = F.concat(F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    return event_signature(F.col("author_account_id"), iso, short_hash(), F.col("relation_id"), F.col("target_account_id"))


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in ``order``. Aggregated before the shuffle, so repeated keys make no hot task."""
    rest = [c for c in df.columns if c not in keys]
    lead = [c for c in order if c not in keys]
    inner = F.struct(*lead, *[c for c in rest if c not in lead])
    return df.groupBy(*keys).agg(F.min_by(inner, F.struct(*lead)).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def authored_counts(interactions: DataFrame, nodes: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Rows that a node wrote per snapshot; a row with several targets counts once."""
    own = indexed(interactions, nodes, config).where("source_idx is not null and snapshot_id is not null")
    rows = own.select("source_file", "source_row_number", "snapshot_id", F.col("source_idx").alias("node_index")).distinct()
    return rows.groupBy("snapshot_id", "node_index").agg(F.count(F.lit(1)).alias("tweet_count"))


def edges(events: DataFrame) -> DataFrame:
    """Canonical edges: distinct signatures per snapshot, relation, source and target, without self-loops; ln(1 + count) as weight."""
    return (
        events.where("source_idx <> target_idx")
        .select("signature", "snapshot_id", "relation_id", F.col("source_idx").alias("src_index"), F.col("target_idx").alias("dst_index"))
        .groupBy(*EDGE, "signature")
        .agg(F.lit(1).alias("one"))
        .groupBy(*EDGE)
        .agg(F.count(F.lit(1)).alias("count_raw"))
        .withColumn("weight_log1p", F.log1p("count_raw"))
    )


def binary(edge: DataFrame) -> DataFrame:
    """The same edges, every one of weight ln 2."""
    return edge.withColumns({"count_raw": F.lit(1).cast("bigint"), "weight_log1p": F.log1p(F.lit(1.0))})


def symmetrized(edge: DataFrame) -> DataFrame:
    """Edges in both directions, counts of both added."""
    both = edge.select(*EDGE, "count_raw").union(edge.select("snapshot_id", "relation_id", F.col("dst_index").alias("src_index"), F.col("src_index").alias("dst_index"), "count_raw"))
    return both.groupBy(*EDGE).agg(F.sum("count_raw").alias("count_raw")).withColumn("weight_log1p", F.log1p("count_raw"))


def collapsed(edge: DataFrame) -> DataFrame:
    """Edges without their relation, counts added."""
    keys = [k for k in EDGE if k != "relation_id"]
    return edge.groupBy(*keys).agg(F.sum("count_raw").alias("count_raw")).withColumn("weight_log1p", F.log1p("count_raw"))


def degrees(edge: DataFrame) -> DataFrame:
    """Per snapshot, relation and node: distinct neighbours and summed counts in both directions."""
    ends = edge.select("snapshot_id", "relation_id", "count_raw", F.explode(F.array(F.struct(F.col("src_index").alias("node_index"), F.lit(1).alias("out")), F.struct(F.col("dst_index").alias("node_index"), F.lit(0).alias("out")))).alias("e"))
    out = F.col("e.out") == 1
    return ends.groupBy("snapshot_id", "relation_id", F.col("e.node_index").alias("node_index")).agg(
        F.count_if(out).alias("out_degree"),
        F.count_if(~out).alias("in_degree"),
        F.coalesce(F.sum(F.when(out, F.col("count_raw"))), F.lit(0)).alias("out_strength"),
        F.coalesce(F.sum(F.when(~out, F.col("count_raw"))), F.lit(0)).alias("in_strength"),
    )


def structural_features(edge: DataFrame, tweets: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The 17 features per active snapshot and node; inactive ones have no row, which stands for zeros.

    Active: wrote at least one row, or has an edge.
    """
    d = degrees(edge).select("snapshot_id", "node_index", "relation_id", "out_degree", "in_degree", F.log1p("out_strength").alias("out_strength_log1p"), F.log1p("in_strength").alias("in_strength_log1p"))
    pick = lambda i, c: F.coalesce(F.max(F.when(F.col("relation_id") == i, F.col(c))), F.lit(0)).cast("double")
    wide = d.groupBy("snapshot_id", "node_index").agg(*[pick(i, f).alias(f"{r}_{f}") for i, r in enumerate(config.relations) for f in ("out_degree", "in_degree", "out_strength_log1p", "in_strength_log1p")])
    wrote = tweets.select("snapshot_id", "node_index", F.log1p("tweet_count").alias("tweet_count_log1p")).where("tweet_count > 0")
    joined = wide.join(wrote, ["snapshot_id", "node_index"], "full")
    return joined.select("snapshot_id", "node_index", *[F.coalesce(F.col(f), F.lit(0.0)).alias(f) for f in FEATURES], F.lit(True).alias("struct_active"))


def active_counts(features: DataFrame) -> DataFrame:
    return features.groupBy("snapshot_id").agg(F.count_if("struct_active").alias("active_nodes"))


def neighbours(edge: DataFrame, nodes: DataFrame, node_index: int, snapshot_id: int | None = None, relation_id: int | None = None) -> DataFrame:
    """What a node points at, by relation and snapshot, with the accounts; filters reach the scan."""
    one = edge.where(F.col("src_index") == node_index)
    if snapshot_id is not None:
        one = one.where(F.col("snapshot_id") == snapshot_id)
    if relation_id is not None:
        one = one.where(F.col("relation_id") == relation_id)
    return one.join(nodes.select(F.col("node_index").alias("dst_index"), "account_id"), "dst_index").select("snapshot_id", "relation_id", "dst_index", "account_id", "count_raw")


def relation_availability(edge: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Per snapshot and node, whether it has any edge of each relation."""
    ends = edge.select("snapshot_id", "relation_id", F.explode(F.array("src_index", "dst_index")).alias("node_index"))
    return ends.groupBy("snapshot_id", "node_index").agg(*[F.bool_or(F.col("relation_id") == i).alias(r) for i, r in enumerate(config.relations)])


def edge_ordinals(edge: DataFrame) -> DataFrame:
    """Edges with edge_idx, their place (from 0) in canonical order: offsets of the partitions plus the place within."""
    sums = edge.groupBy("snapshot_id", "relation_id", "src_index").agg(F.count(F.lit(1)).alias("_n"))
    order = W.partitionBy("snapshot_id").orderBy("relation_id", "src_index").rowsBetween(W.unboundedPreceding, -1)
    per = sums.groupBy("snapshot_id").agg(F.sum("_n").alias("_s"))
    base = per.select("snapshot_id", F.coalesce(F.sum("_s").over(W.partitionBy().orderBy("snapshot_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    offsets = sums.withColumn("_within", F.coalesce(F.sum("_n").over(order), F.lit(0))).join(base, "snapshot_id").select("snapshot_id", "relation_id", "src_index", (F.col("_within") + F.col("_base")).alias("_offset"))
    place = F.row_number().over(W.partitionBy("snapshot_id", "relation_id", "src_index").orderBy("dst_index")) - 1
    return edge.withColumn("_place", place).join(offsets, ["snapshot_id", "relation_id", "src_index"]).withColumn("edge_idx", F.col("_offset") + F.col("_place")).drop("_place", "_offset")


def property_graph(edge: DataFrame, nodes: DataFrame, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, author_account_id) and edges typed by the relation's name; edges of which an end is no vertex are left out."""
    vertices = nodes.select(F.col("node_index").alias("id"), F.col("account_id").alias("author_account_id"))
    names = F.create_map(*[x for i, r in enumerate(config.relations) for x in (F.lit(i), F.lit(r))])
    typed = edge.select(F.col("src_index").alias("src"), F.col("dst_index").alias("dst"), names[F.col("relation_id").cast("int")].alias("relation"), "snapshot_id", "count_raw", "weight_log1p")
    ends = lambda c: vertices.select(F.col("id").alias(c))
    return vertices, typed.join(ends("src"), "src", "left_semi").join(ends("dst"), "dst", "left_semi").select(*typed.columns)


def graph_name(name: str, longest: int = 63) -> str:
    """A name a graph database takes: letters, digits and underscores, a letter in front, at most ``longest`` long."""
    made = re.sub(r"[^A-Za-z0-9_]", "_", name)
    return (made if made[:1].isalpha() else f"g_{made}")[:longest]
