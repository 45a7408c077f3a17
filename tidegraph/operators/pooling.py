"""Unit vectors to vectors of nodes and edges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.hashing import SEPARATOR
from tidegraph.functions.vectors import norm, unit, zeros
from tidegraph.operators.graph import EDGE
from tidegraph.session import ship


def mock_vector(content_hash: str, dimension: int) -> np.ndarray:
    """A unit vector that depends on the hash only: SHA-256 in counter mode, as numbers in [-1, 1]."""
    blocks = -(-dimension * 4 // 32)
    raw = b"".join(hashlib.sha256(f"{content_hash}{SEPARATOR}{i}".encode()).digest() for i in range(blocks))
    v = np.frombuffer(raw, dtype=">u4")[:dimension].astype(np.float64) / 2147483647.5 - 1.0
    return (v / (np.linalg.norm(v) or 1.0)).astype(np.float32)


def mock_encode(units: DataFrame, dimension: int, column: str = "content_hash") -> DataFrame:
    """``units`` with ``embedding``; each distinct text is encoded once and joined back."""
    ship(units.sparkSession)

    @F.arrow_udf("array<float>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [mock_vector(h, dimension) if h is not None else np.zeros(dimension, np.float32) for h in batch.to_pylist()]
            flat = np.concatenate(rows) if rows else np.zeros(0, np.float32)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * dimension), pa.array(flat, pa.float32()))

    once = units.select(column).where(F.col(column).isNotNull()).distinct()
    return units.join(once.withColumn("embedding", encode(F.col(column))), column, "left")


def instructed(text: Column, task: str) -> Column:
    """The text in the form an instructed encoder wants."""
    return F.concat(F.lit(f"Instruct: {task}\nQuery:"), text)


def mean_pool(units: DataFrame, keys: list[str], vector: str = "embedding", normalised: bool = False) -> DataFrame:
    """Mean vector and count per key.

    Vectors are summed place by place: rows of (key, place) are combined on the map side, so a
    key with most of the vectors is no hot task. Units without a vector do not count.
    """
    flat = units.where(F.col(vector).isNotNull()).select(*keys, F.posexplode(vector).alias("pos", "x"))
    sums = flat.groupBy(*keys, "pos").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count(F.lit(1)).alias("n"))
    pooled = sums.groupBy(*keys).agg(F.max("n").alias("valid_count"), F.transform(F.array_sort(F.collect_list(F.struct("pos", (F.col("s") / F.col("n")).alias("m")))), lambda p: p["m"]).alias("vector"))
    return pooled.withColumn("vector", unit(F.col("vector"))) if normalised else pooled


def node_vectors(pooled: DataFrame, grid: DataFrame, dimension: int) -> DataFrame:
    """A vector for every (snapshot_id, node_index) of ``grid``: exact zeros and available = false where there is none."""
    return grid.join(pooled, ["snapshot_id", "node_index"], "left").select(
        "snapshot_id", "node_index", F.coalesce("valid_count", F.lit(0)).alias("valid_count"), F.col("valid_count").isNotNull().alias("available"), F.coalesce("vector", zeros(dimension)).alias("vector")
    )


def edge_vectors(edge: DataFrame, pooled: DataFrame, dimension: int) -> DataFrame:
    """Canonical edges with the pooled vector of their events, zeros where there is none."""
    return edge.join(pooled, EDGE, "left").select(*EDGE, F.coalesce("valid_count", F.lit(0)).alias("valid_count"), F.col("valid_count").isNotNull().alias("available"), F.coalesce("vector", zeros(dimension)).alias("vector"))


def orphan_keys(pooled: DataFrame, edge: DataFrame) -> DataFrame:
    """Pooled keys that are no edge; must be empty."""
    return pooled.select(*EDGE).join(edge.select(*EDGE), EDGE, "left_anti")


def norm_violations(df: DataFrame, key: str, vector: str, tolerance: float = 1e-6) -> DataFrame:
    """Vectors that are neither of length one nor zero."""
    n = norm(F.col(vector))
    return df.select(key, n.alias("norm")).where((F.col("norm") > 0) & (F.abs(F.col("norm") - 1) > tolerance))


def alignment_report(nodes: DataFrame, edges: DataFrame, edge: DataFrame, snapshots: int, universe: int, dimension: int) -> DataFrame:
    """One row of checks between pooled vectors and the graph: sizes, dimension, zeros where nothing is available."""
    nonzero = F.exists("vector", lambda x: x != 0)
    n = nodes.agg(
        F.count(F.lit(1)).alias("node_rows"), F.count_if(F.size("vector") != dimension).alias("node_wrong_size"), F.count_if(~F.col("available") & nonzero).alias("node_not_zero"), F.count_if(F.col("available") != (F.col("valid_count") > 0)).alias("node_mask_wrong")
    )
    e = edges.agg(F.count(F.lit(1)).alias("edge_rows"), F.count_if(F.size("vector") != dimension).alias("edge_wrong_size"), F.count_if(~F.col("available") & nonzero).alias("edge_not_zero"))
    values = {**n.first().asDict(), **e.first().asDict(), "expected_nodes": snapshots * universe, "expected_edges": edge.count()}
    values["aligned"] = values["node_rows"] == values["expected_nodes"] and values["edge_rows"] == values["expected_edges"] and not any(v for k, v in values.items() if k.endswith(("wrong_size", "not_zero", "mask_wrong")))
    return nodes.sparkSession.createDataFrame([values])


#: Children of one node of the tree that ``order_fingerprint`` hashes.
FAN = 1024


def order_fingerprint(edge: DataFrame) -> DataFrame:
    """Per snapshot and relation, a SHA-256 over its edges in canonical order, as the root of a tree of hashes.

    Leaves are lines of edges; ``FAN`` targets in a row are a node, so are ``FAN`` of these, the source, ``FAN`` sources in
    a row, and so on. No node has more than about two thousand children, so no task holds a partition or a hub.
    """
    base = ["snapshot_id", "relation_id"]
    line = F.concat_ws(",", *base, "src_index", "dst_index")
    level = edge.select(*base, "src_index", F.floor(F.col("dst_index") / FAN).alias("d"), F.col("dst_index").cast("bigint").alias("at"), line.alias("h"), F.lit(1).cast("bigint").alias("n"))

    def up(df: DataFrame, keys: list[str]) -> DataFrame:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"])
        return df.groupBy(*base, *keys).agg(F.sha2(F.array_join(ordered, "\n"), 256).alias("h"), F.sum("n").alias("n"))

    level = up(level, ["src_index", "d"]).withColumn("at", F.col("d")).withColumn("d", F.floor(F.col("d") / FAN))
    level = up(level, ["src_index", "d"]).withColumn("at", F.col("d"))
    level = up(level, ["src_index"]).withColumn("at", F.col("src_index").cast("bigint")).withColumn("s", F.floor(F.col("src_index") / FAN))
    level = up(level, ["s"]).withColumn("at", F.col("s")).withColumn("s", F.floor(F.col("s") / FAN))
    level = up(level, ["s"]).withColumn("at", F.col("s"))
    return up(level, []).select(*base, F.col("n").alias("edges"), F.col("h").alias("fingerprint"))
