"""Forward passes of the temporal community model with given weights; nothing is trained here."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.vectors import dot
from tidegraph.session import ship


def _matrix(w: Sequence[Sequence[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in w])


def linear(v: Column, w: Sequence[Sequence[float]], bias: Sequence[float] | None = None) -> Column:
    """W v + b, one row of W per output."""
    out = F.transform(_matrix(w), lambda row: dot(row, v))
    return out if bias is None else F.zip_with(out, F.array(*[F.lit(float(b)) for b in bias]), lambda x, b: x + b)


def relu(v: Column) -> Column:
    return F.transform(v, lambda x: F.greatest(x, F.lit(0.0)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sage_layer(nodes: DataFrame, edge: DataFrame, w_self: Sequence[Sequence[float]], w_neighbour: Sequence[Sequence[float]], incoming: bool = True, weight: str | None = None) -> DataFrame:
    """relu(W_self h + W_neighbour mean of the neighbours' h): snapshot_id, node_index, h.

    Messages are summed place by place on the map side, so a node with most of the edges is no
    hot task. Nodes without neighbours keep their own part only.
    """
    src, dst = ("src_index", "dst_index") if incoming else ("dst_index", "src_index")
    sent = edge.join(nodes.select("snapshot_id", F.col("node_index").alias(src), "h"), ["snapshot_id", src])
    scale = F.col(weight).cast("double") if weight else F.lit(1.0)
    flat = sent.select("snapshot_id", F.col(dst).alias("node_index"), scale.alias("w"), F.posexplode("h").alias("pos", "x"))
    mean = flat.groupBy("snapshot_id", "node_index", "pos").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("m"))
    packed = mean.groupBy("snapshot_id", "node_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"]).alias("m"))
    joined = nodes.join(packed, ["snapshot_id", "node_index"], "left")
    own = linear(F.col("h"), w_self)
    return joined.select("snapshot_id", "node_index", relu(F.when(F.col("m").isNull(), own).otherwise(add(own, linear(F.col("m"), w_neighbour)))).alias("h"))


def edge_gate(features: Column, w: Sequence[float], bias: float) -> Column:
    """A weight in (0, 1) for an edge from its features."""
    return sigmoid(dot(features, F.array(*[F.lit(float(x)) for x in w])) + F.lit(float(bias)))


def gru(states: DataFrame, w: dict[str, np.ndarray], hidden: int) -> DataFrame:
    """Gated recurrent states per node over its snapshots: snapshot_id, node_index, s.

    ``states``: snapshot_id, node_index, h, active. An inactive snapshot carries the state on
    unchanged; the first state is zero. A group is one node's snapshots, at most as many as
    the calendar has. ``w``: W_z, U_z, W_r, U_r, W_n, U_n as matrices.
    """
    ship(states.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("snapshot_id")
        s, out = np.zeros(hidden), []
        for h, active in zip(pdf["h"], pdf["active"]):
            if active and h is not None:
                x = np.asarray(h, dtype=float)
                z = 1 / (1 + np.exp(-(w["W_z"] @ x + w["U_z"] @ s)))
                r = 1 / (1 + np.exp(-(w["W_r"] @ x + w["U_r"] @ s)))
                n = np.tanh(w["W_n"] @ x + w["U_n"] @ (r * s))
                s = (1 - z) * n + z * s
            out.append(s.tolist())
        return pd.DataFrame({"snapshot_id": pdf["snapshot_id"], "node_index": pdf["node_index"], "s": out})

    return states.select("snapshot_id", "node_index", "h", "active").groupBy("node_index").applyInPandas(run, "snapshot_id int, node_index int, s array<double>")


def link_logit(a: Column, b: Column, relation: Sequence[float]) -> Column:
    """Score of a link between two states under a relation: sum of products of the three vectors."""
    return dot(F.zip_with(a, F.array(*[F.lit(float(x)) for x in relation]), lambda x, r: x * r), b)
