"""Whole runs: from source tables to published tables and sealed reports."""

from __future__ import annotations

import platform
from collections.abc import Mapping
from datetime import datetime, timezone
from typing import Any

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.config import DEFAULT, FEATURES, Config
from tidegraph.functions import times
from tidegraph.functions.hashing import canonical_hash, schema_signature
from tidegraph.functions.text import is_blank
from tidegraph.operators import diagnostics, graph, pooling, profile, records, selection, validate
from tidegraph.schemas import EDGES, EVENTS, mismatches
from tidegraph.session import written
from tidegraph.sources.files import canonical_edges, checked_table
from tidegraph.sources.sinks import seal, small_report, write_edges, write_table


def run_id(config: Config, at: datetime | None = None) -> str:
    """A name for a run: when it began, and its settings."""
    return f"{(at or datetime.now(timezone.utc)).strftime('%Y%m%dT%H%M%SZ')}_cfg-{config.fingerprint()[:8]}"


def environment(spark: SparkSession) -> dict[str, str]:
    return {"python": platform.python_version(), "pyspark": pyspark.__version__, "spark": spark.version, "system": platform.system()}


def build_graph(interactions: DataFrame, nodes: DataFrame, out: str, config: Config = DEFAULT) -> dict[str, Any]:
    """Events, edges by snapshot and relation, features and authored counts below ``out``; the report with its gates.

    Raises if a gate fails, before anything is called complete.
    """
    spark = interactions.sparkSession
    gate = small_report(validate.node_map_gate(nodes))[0]
    if not gate["contiguous"]:
        raise ValueError("the node map is not contiguous")
    write_table(graph.relation_events(interactions, nodes, config), f"{out}/events")
    events = spark.read.parquet(f"{out}/events")
    write_edges(graph.edges(events), f"{out}/edges")
    edges = canonical_edges(spark, f"{out}/edges").select("snapshot_id", "relation_id", "src_index", "dst_index", "count_raw", "weight_log1p")
    write_table(graph.authored_counts(interactions, nodes, config), f"{out}/authored")
    authored = spark.read.parquet(f"{out}/authored")
    write_table(graph.structural_features(edges, authored, config), f"{out}/x_struct")
    features = spark.read.parquet(f"{out}/x_struct")
    write_table(times.calendar(spark, config), f"{out}/calendar")
    violations = {r["problem"]: r["edges"] for r in small_report(validate.edge_gates(edges, config))}
    report = {
        "ladder": {r["reason"]: r["rows"] for r in small_report(graph.ladder_counts(interactions, nodes, config))},
        "nodes": gate,
        "edges": edges.count(),
        "edge_partitions": small_report(edges.groupBy("snapshot_id", F.col("relation_id").cast("int").alias("relation_id")).count()),
        "active_rows": features.count(),
        "features": list(FEATURES),
        "violations": violations,
        "broken_features": validate.feature_violations(features).count(),
        "event_schema": mismatches(events, EVENTS),
    }
    if violations or report["broken_features"] or report["event_schema"]:
        raise ValueError(f"the graph fails its gates: {violations or report['event_schema'] or 'features'}")
    return seal({"graph": report}, f"{out}/reports", config.fingerprint())


def normalise_records(raw: DataFrame, nodes: DataFrame, out: str, config: Config = DEFAULT) -> dict[str, Any]:
    """Normalised records by status below ``out``, with duplicates, accounts and statistics; rows in = retained + excluded + rejected."""
    spark = raw.sparkSession
    write_table(records.normalise(raw, nodes, config), f"{out}/records", ["record_status"])
    done = spark.read.parquet(f"{out}/records")
    retained = done.where("record_status = 'retained'")
    write_table(records.duplicate_report(retained), f"{out}/duplicates")
    write_table(records.account_reconciliation(done, nodes), f"{out}/accounts")
    accounting = small_report(records.row_accounting(done))
    report = {
        "accounting": accounting,
        "reasons": small_report(done.groupBy("record_status", "exclusion_reason").count()),
        "snapshots": small_report(retained.groupBy("snapshot_id").count()),
        "quality": small_report(records.text_quality_statistics(done)),
        "duplicates": small_report(records.duplicate_summary(records.duplicate_groups(retained, F.col("tweet_id"), records.post_content()))),
    }
    if any(r["rows_in"] != r["retained"] + r["excluded"] + r["rejected"] for r in accounting) or raw.count() != sum(r["rows_in"] for r in accounting):
        raise ValueError("rows are missing from the accounting")
    return seal({"records": report}, f"{out}/reports", config.fingerprint())


def run_diagnostics(interactions: DataFrame, texts: DataFrame, nodes: DataFrame, out: str, config: Config = DEFAULT) -> dict[str, Any]:
    """Calendar, duplicates, text lengths and coverage as four sealed reports; no ids, texts or paths in them."""
    spark = interactions.sparkSession
    rows = written(graph.indexed(interactions, nodes, config).select("author_account_id", "target_account_id", "relation_id", "created", "snapshot_id", "source_idx", "target_idx"), "indexed")
    quarters = times.calendar(spark, config)
    calendar = diagnostics.calendar_report(rows.select("snapshot_id", F.col("source_idx").alias("node_index"), "created"), quarters)
    links = rows.where(diagnostics.coverage_reason() == "accepted").where("snapshot_id is not null and target_idx is not null")
    struct = links.select("snapshot_id", F.explode(F.array("source_idx", "target_idx")).alias("node_index"))
    with_text = texts.where(~is_blank(F.col("text_normalized"))).select("snapshot_id", "node_index")
    groups = records.duplicate_groups(texts, F.col("tweet_id"), records.post_content())
    made = {
        "calendar": {"quarters": small_report(calendar), "empty": small_report(diagnostics.empty_quarters(calendar)), "reasons": small_report(diagnostics.reason_counts(rows, diagnostics.coverage_reason()))},
        "duplicates": {"summary": small_report(records.duplicate_summary(groups)), "multiplicity": small_report(records.multiplicity(groups))},
        "lengths": {"all": small_report(diagnostics.length_summary(texts.withColumn("part", F.lit("all")), "text_normalized", ["part"], config)), "snapshots": small_report(diagnostics.length_summary(texts, "text_normalized", ["snapshot_id"], config)), "classes": small_report(diagnostics.text_class_counts(texts, "text_normalized", []))},
        "coverage": {"snapshots": small_report(diagnostics.coverage_by_snapshot(struct, with_text, quarters, nodes.count()))},
    }
    return seal(made, f"{out}/reports", config.fingerprint())


def build_embeddings(texts: DataFrame, duplicates: DataFrame, nodes: DataFrame, edge: DataFrame, events: DataFrame, out: str, config: Config = DEFAULT, limit: int | None = None) -> dict[str, Any]:
    """Eligible units, a stratified sample of them if ``limit`` is given, their vectors, pooled and aligned with the graph.

    The encoder is the deterministic stand-in; a real one is any function from texts to vectors in its place.
    """
    spark = texts.sparkSession
    d = config.dimension
    node_units = selection.node_units(texts, duplicates).where("reason is null and node_index is not null and snapshot_id is not null")
    edge_units = selection.event_units(events).where("reason is null and source_idx <> target_idx")
    if limit:
        node_units = selection.stratified_sample(selection.with_strata(node_units, "node_index", "text_normalized", config), ["snapshot_id", "activity_level", "length_level"], limit)
        edge_units = selection.stratified_sample(selection.with_strata(edge_units, "source_idx", "cleaned_text", config), ["snapshot_id", "activity_level", "length_level"], limit, "relation_id")
    write_table(pooling.mock_encode(node_units.select("unit_hash", "content_hash", "snapshot_id", "node_index"), d), f"{out}/node_units")
    write_table(pooling.mock_encode(edge_units.select("unit_hash", "content_hash", "snapshot_id", F.col("relation_id").cast("tinyint").alias("relation_id"), F.col("source_idx").alias("src_index"), F.col("target_idx").alias("dst_index")), d), f"{out}/edge_units")
    pooled_nodes = pooling.mean_pool(spark.read.parquet(f"{out}/node_units"), ["snapshot_id", "node_index"])
    pooled_edges = pooling.mean_pool(spark.read.parquet(f"{out}/edge_units"), graph.EDGE)
    every = nodes.select("node_index", F.explode(F.sequence(F.lit(0), F.lit(config.snapshots - 1))).alias("snapshot_id"))
    write_table(pooling.node_vectors(pooled_nodes, every, d), f"{out}/nodes")
    write_table(pooling.edge_vectors(edge, pooled_edges, d), f"{out}/edges")
    orphans = pooling.orphan_keys(pooled_edges, edge).limit(1).count()
    aligned = small_report(pooling.alignment_report(spark.read.parquet(f"{out}/nodes"), spark.read.parquet(f"{out}/edges"), edge, config.snapshots, nodes.count(), d))[0]
    if orphans or not aligned["aligned"]:
        raise ValueError("the vectors do not fit the graph")
    return seal({"alignment": aligned, "order": {"partitions": small_report(pooling.order_fingerprint(edge).withColumn("relation_id", F.col("relation_id").cast("int")))}}, f"{out}/reports", config.fingerprint())


def discover(tables: Mapping[str, DataFrame]) -> dict[str, Any]:
    """What is known of tables seen for the first time: columns, their roles, types and signatures."""
    out = {}
    for name, df in tables.items():
        out[name] = {
            "columns": df.columns,
            "signature": schema_signature(df.columns),
            "ordered_signature": schema_signature(df.columns, ordered=True),
            "roles": profile.column_roles(df.columns),
            "profile": small_report(profile.column_profile(df)),
        }
    return {"tables": out, "hash": canonical_hash({k: v["ordered_signature"] for k, v in out.items()})}


def check_package(spark: SparkSession, root: str, config: Config = DEFAULT) -> list[str]:
    """What is wrong with a published graph: schema, keys, weights, features."""
    out: list[str] = []
    try:
        edges = canonical_edges(spark, f"{root}/edges")
        bad = [m for m in mismatches(edges.withColumn("relation_id", F.col("relation_id").cast("tinyint")), EDGES)]
        out += [f"edges: {m}" for m in bad]
        out += [f"edges: {r['problem']} ({r['edges']})" for r in small_report(validate.edge_gates(edges, config))]
        out += [f"edges outside the calendar: {r['snapshot_id']}" for r in small_report(validate.snapshot_violations(edges, config))]
        checked_table(spark, f"{root}/events", EVENTS)
        broken = validate.feature_violations(spark.read.parquet(f"{root}/x_struct")).count()
        out += [f"features: {broken} broken rows"] if broken else []
    except (ValueError, pyspark.errors.PySparkException) as e:
        out.append(str(e).splitlines()[0])
    return out
