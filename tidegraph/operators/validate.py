"""Checks: each returns the rows that violate it, or one row of counts."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegraph.config import DEFAULT, FEATURES, Config
from tidegraph.functions.text import plain_status
from tidegraph.operators.graph import EDGE


def node_violations(nodes: DataFrame, universe: int) -> DataFrame:
    """Indices that are NULL, outside [0, universe), used twice, or accounts used twice."""
    bad = nodes.where(F.col("node_index").isNull() | ~F.col("node_index").between(0, universe - 1)).select(F.lit("out_of_bounds").alias("problem"), F.col("node_index").cast("string").alias("value"))
    twice = lambda c, name: nodes.groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(name).alias("problem"), F.col(c).cast("string").alias("value"))
    return bad.unionByName(twice("node_index", "repeated_index")).unionByName(twice("account_id", "repeated_account"))


def node_map_gate(nodes: DataFrame) -> DataFrame:
    """One row: count, distinct accounts and indices, bounds, whether the indices are contiguous from 0."""
    return nodes.agg(
        F.count(F.lit(1)).alias("nodes"), F.count_distinct("account_id").alias("accounts"), F.count_distinct("node_index").alias("indices"), F.min("node_index").alias("lowest"), F.max("node_index").alias("highest")
    ).withColumn("contiguous", (F.col("indices") == F.col("nodes")) & (F.col("lowest") == 0) & (F.col("highest") == F.col("nodes") - 1))


def edge_violations(edge: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Self-loops, wrong relations, counts below one, weights off by more than the tolerance, repeated keys."""
    problems = F.array_compact(
        F.array(
            F.when(F.col("src_index") == F.col("dst_index"), F.lit("self_loop")),
            F.when(~F.coalesce(F.col("relation_id").between(0, len(config.relations) - 1), F.lit(False)), F.lit("wrong_relation")),
            F.when(F.coalesce(F.col("count_raw"), F.lit(0)) < 1, F.lit("count_not_positive")),
            F.when(~F.coalesce(F.abs(F.col("weight_log1p") - F.log1p("count_raw")) <= config.weight_tolerance, F.lit(False)), F.lit("wrong_weight")),
        )
    )
    single = edge.select(*EDGE, F.explode(problems).alias("problem"))
    repeated = edge.groupBy(*EDGE).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*EDGE, F.lit("repeated_key").alias("problem"))
    return single.unionByName(repeated)


def edge_gates(edge: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """How many violations of each kind; kinds without any have no row."""
    return edge_violations(edge, config).groupBy("problem").agg(F.count(F.lit(1)).alias("edges"))


def snapshot_violations(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return df.where(F.col("snapshot_id").isNull() | ~F.col("snapshot_id").between(0, config.snapshots - 1)).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("rows"))


def feature_violations(features: DataFrame) -> DataFrame:
    """Rows with values that are no finite numbers, or inactive rows that are not zero."""
    off = lambda f: F.col(f).isNull() | F.isnan(f) | (F.abs(F.col(f)) == float("inf"))
    broken = F.exists(F.array(*[off(f) for f in FEATURES]), lambda x: x)
    loud = ~F.col("struct_active") & F.exists(F.array(*[F.col(f) for f in FEATURES]), lambda x: x != 0)
    return features.where(broken | loud).select("snapshot_id", "node_index", F.when(broken, "not_finite").otherwise("inactive_not_zero").alias("problem"))


def vector_violations(df: DataFrame, key: str, vector: str, dimension: int, available: str | None = None) -> DataFrame:
    """Vectors of the wrong size, with values that are no finite numbers, or not zero where unavailable."""
    v = F.col(vector)
    problem = F.when(v.isNull() | (F.size(v) != dimension), "wrong_size").when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not_finite")
    if available:
        problem = problem.when(~F.col(available) & F.exists(v, lambda x: x != 0), "unavailable_not_zero")
    return df.select(key, problem.alias("problem")).where("problem is not null")


def activity_violations(df: DataFrame) -> DataFrame:
    """Rows whose model_active is not structure or node text; edge text never makes a node active."""
    want = F.coalesce("struct_active", F.lit(False)) | F.coalesce("node_text_available", F.lit(False))
    return df.where(F.col("model_active") != want)


def shard_violations(expected: DataFrame, present: DataFrame, key: str = "shard_id") -> DataFrame:
    """Shards that are missing, unexpected or there twice."""
    e, p = expected.select(key).distinct(), present.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    joined = e.withColumn("e", F.lit(1)).join(p, key, "full")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(F.col("n") > 1, "repeated")
    return joined.select(key, problem.alias("problem")).where("problem is not null")


def unknown_values(df: DataFrame, column: str, allowed: Iterable[Any]) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed)).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def _gate_rows(df: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """One row per gate from a table of one row: gate and passed."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(g).alias("gate"), F.coalesce(c, F.lit(False)).alias("passed")) for g, c in gates.items()])).alias("g")).select("g.*")


def graph_gates(features: DataFrame, edge: DataFrame, events: DataFrame, nodes: DataFrame, universe: int, config: Config = DEFAULT) -> DataFrame:
    """The gates of a published graph, one row each: gate and passed.

    Features have their rows where a node is active, so a missing row stands for zeros and the shape is that of snapshots and nodes.
    """
    off = lambda f: F.col(f).isNull() | F.isnan(f) | (F.abs(F.col(f)) == float("inf"))
    loud = F.exists(F.array(*[F.col(f) for f in FEATURES]), lambda x: x != 0)
    x = features.agg(
        F.count_if(~F.col("snapshot_id").between(0, config.snapshots - 1) | ~F.col("node_index").between(0, universe - 1)).alias("x_outside"),
        F.count_if(F.exists(F.array(*[off(f) for f in FEATURES]), lambda b: b)).alias("x_broken"),
        F.count_if(~F.col("struct_active") & loud).alias("x_loud"),
        F.count(F.lit(1)).alias("x_rows"),
    )
    keys = features.select("snapshot_id", "node_index").distinct().agg(F.count(F.lit(1)).alias("x_keys"))
    e = edge.agg(
        F.count_if(F.col("src_index") == F.col("dst_index")).alias("loops"), F.count_if(~F.coalesce(F.abs(F.col("weight_log1p") - F.log1p("count_raw")) <= config.weight_tolerance, F.lit(False))).alias("weights"),
        F.count_if(~F.coalesce(F.col("relation_id").between(0, len(config.relations) - 1), F.lit(False))).alias("relations"), F.count_if(~F.coalesce(F.col("src_index").between(0, universe - 1) & F.col("dst_index").between(0, universe - 1), F.lit(False))).alias("ends"),
    )
    twice = edge.groupBy(*EDGE).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated"))
    ev = events.agg(F.count(F.lit(1)).alias("events"))
    n = node_map_gate(nodes)
    one = x.join(keys, F.lit(True)).join(e, F.lit(True)).join(twice, F.lit(True)).join(ev, F.lit(True)).join(n, F.lit(True))
    zero = lambda c: F.col(c) == 0
    return _gate_rows(
        one,
        {
            "x_struct_shape": zero("x_outside"), "mask_shape": F.col("x_rows") == F.col("x_keys"), "x_struct_finite": zero("x_broken"), "inactive_rows_zero": zero("x_loud"), "n_nodes": F.col("nodes") == universe, "node_map_contiguous": F.col("contiguous"),
            "weight_log1p_ok": zero("weights"), "no_self_loops": zero("loops"), "relations_known": zero("relations"), "ends_in_universe": zero("ends"), "edge_keys_unique": zero("repeated"), "has_events": F.col("events") > 0,
        },
    )


def record_gates(records: DataFrame, rows_in: int, universe: int, config: Config = DEFAULT) -> DataFrame:
    """The gates of normalised records, one row each: gate and passed. ``rows_in`` is the number of raw rows."""
    s = plain_status(F.col("record_status"))
    kept = s == "retained"
    bad = lambda c: F.count_if(kept & ~F.coalesce(c, F.lit(False)))
    one = records.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(s == x).alias(x) for x in ("retained", "excluded", "rejected")],
        bad(F.col("tweet_id").rlike(r"^\d{15,20}$")).alias("ids"), bad(F.col("node_index").isNotNull()).alias("nodes"), bad(F.col("node_index").isNull() | F.col("node_index").between(0, universe - 1)).alias("range"),
        bad(F.col("snapshot_id").between(0, config.snapshots - 1)).alias("snapshots"), bad(F.col("created_at_utc").isNotNull()).alias("times"), F.count_if(kept & F.col("exclusion_reason").isNotNull()).alias("reasons"),
        F.count_if(s.isin("excluded", "rejected") & F.col("exclusion_reason").isNull()).alias("unexplained"),
    )
    places = records.groupBy("source_file", "source_row_number").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated"))
    zero = lambda c: F.col(c) == 0
    return _gate_rows(
        one.join(places, F.lit(True)),
        {
            "tweet_ids_exact": zero("ids"), "retained_all_have_node_index": zero("nodes"), "node_index_in_range": zero("range"), "retained_snapshot_in_range": zero("snapshots"), "retained_all_have_time": zero("times"), "retained_have_no_reason": zero("reasons"),
            "others_have_a_reason": zero("unexplained"), "statuses_known": F.col("rows") == F.col("retained") + F.col("excluded") + F.col("rejected"), "row_accounting_balances": F.lit(rows_in) == F.col("retained") + F.col("excluded") + F.col("rejected"),
            "locations_unique": zero("repeated"), "has_retained": F.col("retained") > 0,
        },
    )


# Keys a published report must not have, in lower case.
_FORBIDDEN = frozenset(
    """text text_raw text_normalized cleaned_text ocr_text full_text content tweet_id author_id author_account_id account_id username screen_name source_user_id target_user_id
    external_user_id user_blob email path password secret credentials api_key access_token refresh_token service_account private_key""".split()
)
_MAIL = re.compile(r"[\w.+%-]+@[\w-]+\.[\w.-]+")
_PATH = re.compile(r"(?:^|[\s\"'=])(?:/[\w.\-]+){2,}|[A-Za-z]:\\")
#: Ids shorter than this are too common as parts of other numbers to be looked for.
SHORTEST_ID = 6


def privacy_findings(report: Any, path: str = "$", forbidden: Iterable[str] = (), known_ids: frozenset[str] = frozenset(), longest: int = 200) -> list[str]:
    """Places of a report that must not be published: forbidden keys (in any case), mail addresses, absolute paths, long texts, known ids anywhere in a text."""
    out: list[str] = []
    keys = _FORBIDDEN | {str(f).lower() for f in forbidden}

    def known(text: str) -> bool:
        return text in known_ids or any(run in known_ids for run in re.findall(r"\w+", text)) or any(len(i) >= SHORTEST_ID and i in text for i in known_ids)

    def walk(node: Any, at: str) -> None:
        if isinstance(node, Mapping):
            for k, v in node.items():
                if str(k).strip().lower() in keys:
                    out.append(f"{at}.{k}: forbidden key")
                walk(v, f"{at}.{k}")
        elif isinstance(node, (list, tuple)):
            for i, v in enumerate(node):
                walk(v, f"{at}[{i}]")
        elif isinstance(node, str):
            for bad, what in ((_MAIL.search(node), "mail address"), (_PATH.search(node), "absolute path"), (len(node) > longest, "long text"), (known(node), "known id")):
                if bad:
                    out.append(f"{at}: {what}")

    walk(report, path)
    return out


def relation_map_violations(relations: Mapping[str, int], names: Iterable[str]) -> list[str]:
    """What keeps a relation map from being the names numbered from 0 in their order."""
    want = {n: i for i, n in enumerate(names)}
    out = [f"{n} is missing" for n in want if n not in relations]
    out += [f"{n} is unknown" for n in relations if n not in want]
    return out + [f"{n} is {relations[n]}, not {i}" for n, i in want.items() if n in relations and relations[n] != i]


def snapshot_order_violations(calendar: DataFrame) -> DataFrame:
    """Snapshots that are repeated, or do not begin where the one before ends: snapshot_id and problem.

    The calendar is one row per quarter, so its order is one small window.
    """
    w = W.partitionBy().orderBy("snapshot_id", "start")
    before = calendar.select("snapshot_id", "start", "end", F.lag("snapshot_id").over(w).alias("p"), F.lag("end").over(w).alias("e"))
    problem = F.when(F.col("snapshot_id") == F.col("p"), "repeated").when(F.col("snapshot_id") != F.col("p") + 1, "gap_in_numbers").when(F.col("start") != F.col("e"), "gap_in_time")
    return before.select("snapshot_id", problem.alias("problem")).where("problem is not null")


#: Stages a diagnostics run goes through; it is never certified by itself.
STATUSES = ("absent", "running", "incomplete", "completed", "sealed", "failed")
_NEXT = {"absent": {"running"}, "running": {"incomplete", "completed", "failed"}, "incomplete": {"running", "failed"}, "completed": {"sealed", "failed"}, "sealed": set(), "failed": {"running"}}


def next_status(now: str, then: str) -> str:
    """``then`` if a run may go from ``now`` to it; raises otherwise."""
    if now not in _NEXT or then not in _NEXT[now]:
        raise ValueError(f"a run that is {now} cannot become {then}")
    return then
