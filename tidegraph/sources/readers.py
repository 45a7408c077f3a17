"""Readers of published tables that say what is wrong with the rows they read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.config import DEFAULT, Config
from tidegraph.operators.graph import EDGE

NODE_TEXT = ("tweet_id", "node_index", "snapshot_id", "source_file", "source_row_number")
EVENT_TEXT = ("signature", "snapshot_id", "relation_id", "source_idx", "target_idx", "source_file", "source_row_number")


def _checked(df: DataFrame, columns: Sequence[str], required: Sequence[str], bounds: Mapping[str, tuple[int, int]], rules: Mapping[str, Column]) -> DataFrame:
    """``columns`` of ``df`` and ``problem``: the first of null_<column>, out_of_bounds_<column> and the rules' names, NULL for a sound row."""
    problem = F.lit(None).cast("string")
    tests = [(f"null_{c}", F.col(c).isNull()) for c in required]
    tests += [(f"out_of_bounds_{c}", ~F.col(c).between(low, high)) for c, (low, high) in bounds.items()]
    tests += list(rules.items())
    for name, bad in reversed(tests):
        problem = F.when(F.coalesce(bad, F.lit(False)), name).otherwise(problem)
    return df.select(*columns, problem.alias("problem"))


def node_texts(records: DataFrame, universe: int, config: Config = DEFAULT) -> DataFrame:
    """Normalised records as text units of nodes; the text is called cleaned_text."""
    named = records.withColumnRenamed("text_normalized", "cleaned_text")
    columns = ["tweet_id", "node_index", "snapshot_id", "cleaned_text", "text_quality", "source_file", "source_sheet", "source_row_number", "is_duplicate", "is_canonical_duplicate"]
    return _checked(named, columns, NODE_TEXT, {"node_index": (0, universe - 1), "snapshot_id": (0, config.snapshots - 1)}, {})


def event_texts(events: DataFrame, universe: int, config: Config = DEFAULT) -> DataFrame:
    """Events as text units of edges."""
    columns = ["signature", "snapshot_id", "relation_id", "source_idx", "target_idx", "cleaned_text", "text_hash", "text_quality", "source_file", "source_row_number"]
    bounds = {"source_idx": (0, universe - 1), "target_idx": (0, universe - 1), "snapshot_id": (0, config.snapshots - 1), "relation_id": (0, len(config.relations) - 1)}
    return _checked(events, columns, EVENT_TEXT, bounds, {"self_loop": F.col("source_idx") == F.col("target_idx")})


def edges(table: DataFrame, universe: int, config: Config = DEFAULT) -> DataFrame:
    """Canonical edges; weights must be the logarithm of one more than their counts."""
    columns = [*EDGE, "count_raw", "weight_log1p"]
    finite = F.abs("weight_log1p") < float("inf")
    rules = {
        "self_loop": F.col("src_index") == F.col("dst_index"),
        "count_not_positive": F.col("count_raw") <= 0,
        "weight_not_finite": ~F.coalesce(finite & ~F.isnan("weight_log1p"), F.lit(False)),
        "wrong_weight": F.abs(F.col("weight_log1p") - F.log1p("count_raw")) > config.weight_tolerance,
    }
    bounds = {"src_index": (0, universe - 1), "dst_index": (0, universe - 1), "snapshot_id": (0, config.snapshots - 1), "relation_id": (0, len(config.relations) - 1)}
    return _checked(table, columns, columns, bounds, rules)


def sound(checked: DataFrame) -> DataFrame:
    """The rows of a checked table; raises if any has a problem."""
    bad = checked.where("problem is not null").groupBy("problem").agg(F.count(F.lit(1)).alias("rows")).orderBy("problem").limit(100).collect()
    if bad:
        raise ValueError("; ".join(f"{r.problem}: {r.rows} rows" for r in bad))
    return checked.drop("problem")
