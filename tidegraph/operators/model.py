"""Data-parallel mathematics of the community model, and metrics of partitions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegraph.functions.vectors import cosine, square_distance, unit
from tidegraph.session import ship

MAX_PROTOTYPES = 10_000


def robust_scaler(df: DataFrame, features: list[str]) -> DataFrame:
    """Median and scale (interquartile range, 1 if that vanishes) per feature: feature, median, scale."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("p")).select("p.*")
    counted = long.groupBy("feature", "x").agg(F.count(F.lit(1)).alias("n"))
    q = counted.groupBy("feature").agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n")).alias("q"))
    spread = F.col("q")[2] - F.col("q")[0]
    return q.select("feature", F.col("q")[1].alias("median"), F.when(spread < 1e-12, F.lit(1.0)).otherwise(spread).alias("scale"))


def robust_scaled(df: DataFrame, features: list[str], scaler: DataFrame, active: str | None = None) -> DataFrame:
    """``df`` with each feature as (x - median) / scale; inactive rows become zeros. The scaler is one row per feature."""
    known = {r.feature: (r.median, r.scale) for r in scaler.where(F.col("feature").isin(*features)).collect()}
    on = F.col(active) if active else F.lit(True)
    return df.withColumns({f: F.when(on, (F.col(f) - known[f][0]) / known[f][1]).otherwise(F.lit(0.0)) for f in features if f in known})


def _prototypes(mu: DataFrame) -> DataFrame:
    if mu.limit(MAX_PROTOTYPES + 1).count() > MAX_PROTOTYPES:
        raise ValueError(f"more than {MAX_PROTOTYPES} prototypes")
    return F.broadcast(mu)


def student_t(points: DataFrame, mu: DataFrame, key: str, vector: str, alpha: float = 1.0) -> DataFrame:
    """Soft assignment of points to prototypes (cluster, mu): q in proportion to (1 + d² / alpha) ** -((alpha + 1) / 2).

    The prototypes are one array in one row, whose size is checked, so each point meets them in its own row.
    """
    all_mu = _prototypes(mu).agg(F.array_sort(F.collect_list(F.struct("cluster", "mu"))).alias("_mu")).scalar()
    power = -(alpha + 1.0) / 2.0
    weights = F.transform("_all", lambda m: F.struct(m["cluster"].alias("cluster"), F.pow(1.0 + square_distance(F.col(vector), m["mu"]) / alpha, F.lit(power)).alias("w")))
    return (
        points.withColumn("_all", all_mu)
        .withColumn("_w", weights)
        .withColumn("_sum", F.aggregate("_w", F.lit(0.0), lambda s, x: s + x["w"]))
        .select(key, F.explode("_w").alias("w"), "_sum")
        .select(key, F.col("w.cluster").alias("cluster"), (F.col("w.w") / F.col("_sum")).alias("q"))
    )


def assignments(q: DataFrame, key: str) -> DataFrame:
    """Per point: the likeliest cluster (the first of equal ones), its probability, and the entropy in nats."""
    best = F.max_by(F.struct("cluster", "q"), F.struct(F.col("q"), -F.col("cluster")))
    h = -F.sum(F.when(F.col("q") > 0, F.col("q") * F.ln("q")).otherwise(0.0))
    return q.groupBy(key).agg(best.alias("b"), h.alias("entropy")).select(key, F.col("b.cluster").alias("cluster"), F.col("b.q").alias("confidence"), "entropy")


def dec_target(q: DataFrame, key: str, frequency: str = "q2") -> DataFrame:
    """Sharpened target p in proportion to q² / f; f is the cluster's sum of q² (or of q, with frequency='q')."""
    power = F.col("q") * F.col("q")
    f = q.groupBy("cluster").agg(F.sum(power if frequency == "q2" else F.col("q")).alias("f"))
    raw = q.join(f, "cluster").withColumn("r", power / F.col("f"))
    return raw.join(raw.groupBy(key).agg(F.sum("r").alias("s")), key).select(key, "cluster", "q", (F.col("r") / F.col("s")).alias("p"))


def cluster_kl(pq: DataFrame, key: str) -> DataFrame:
    """Mean over points of KL(P || Q): one row."""
    per = pq.groupBy(key).agg(F.sum(F.when(F.col("p") > 0, F.col("p") * F.ln(F.col("p") / F.col("q"))).otherwise(0.0)).alias("kl"))
    return per.agg(F.avg("kl").alias("kl"))


def prototype_separation(mu: DataFrame, margin: float = 1.0) -> DataFrame:
    """Mean over ordered pairs of max(0, margin - distance²): one row. Prototypes meet as one array."""
    one = _prototypes(mu).agg(F.collect_list(F.struct("cluster", "mu")).alias("m"))
    loss = lambda a, b: F.when(a["cluster"] == b["cluster"], 0.0).otherwise(F.greatest(F.lit(0.0), margin - square_distance(a["mu"], b["mu"])))
    total = F.aggregate("m", F.lit(0.0), lambda s, a: s + F.aggregate("m", F.lit(0.0), lambda t, b: t + loss(a, b)))
    n = F.size("m")
    return one.select(F.when(n > 1, total / (n * (n - 1))).otherwise(0.0).alias("separation"))


def js_divergence(p: Column, q: Column, eps: float = 1e-12) -> Column:
    """One summand of the Jensen-Shannon divergence."""
    a, b = F.greatest(p, F.lit(eps)), F.greatest(q, F.lit(eps))
    m = (a + b) / 2
    return 0.5 * a * F.ln(a / m) + 0.5 * b * F.ln(b / m)


def mean_js(left: DataFrame, right: DataFrame, keys: list[str], over: str) -> DataFrame:
    """Mean over keys of the divergence between two distributions over ``over`` (columns p and q): one row."""
    both = left.select(*keys, over, "p").join(right.select(*keys, over, "q"), [*keys, over], "full").fillna(0.0, ["p", "q"])
    per = both.groupBy(*keys).agg(F.sum(js_divergence(F.col("p"), F.col("q"))).alias("js"))
    return per.agg(F.avg("js").alias("js"))


def kmeans_step(points: DataFrame, mu: DataFrame, key: str, vector: str) -> DataFrame:
    """One Lloyd step from given centres: cluster, members and the new centre (the old one if it has no members)."""
    all_mu = _prototypes(mu).agg(F.array_sort(F.collect_list(F.struct("cluster", "mu"))).alias("_mu")).scalar()
    near = F.array_min(F.transform("_all", lambda m: F.struct(square_distance(F.col(vector), m["mu"]).alias("d"), m["cluster"].alias("cluster"))))
    own = points.withColumn("_all", all_mu).select(key, vector, near.alias("n")).select(key, vector, F.col("n.cluster").alias("cluster"))
    flat = own.select("cluster", F.posexplode(vector).alias("pos", "x")).groupBy("cluster", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    new = flat.groupBy("cluster").agg(F.max("n").alias("members"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"]).alias("centre"))
    return mu.join(new, "cluster", "left").select("cluster", F.coalesce("members", F.lit(0)).alias("members"), F.coalesce("centre", "mu").alias("centre"))


def _nearest(points: DataFrame, key: str, vector: str, centres: list[list[float]]) -> DataFrame:
    """``key``, ``vector``, the nearest centre (the first of equal ones) and the square of its distance."""
    every = F.array(*[F.struct(F.lit(i).alias("cluster"), F.array(*[F.lit(float(x)) for x in c]).alias("mu")) for i, c in enumerate(centres)])
    near = F.array_min(F.transform(every, lambda m: F.struct(square_distance(F.col(vector), m["mu"]).alias("d"), m["cluster"].alias("cluster"))))
    return points.select(key, vector, near.alias("_n")).select(key, vector, F.col("_n.cluster").alias("cluster"), F.col("_n.d").alias("d"))


def kmeans(points: DataFrame, key: str, vector: str, k: int, seed: int = 7, restarts: int = 1, most: int = 50) -> dict:
    """k-means with spread first centres, restarts, and refilled clusters: centres, inertia, rounds of the best start.

    First centres are drawn one by one with chances in proportion to the square of the distance to those drawn before
    (k-means++), by hashes instead of a generator, so the result is the same on any cluster. A cluster that loses all its
    points gets the point farthest from its own centre. Each step is one aggregation over the points; what the
    driver holds are k centres, at most ``MAX_PROTOTYPES``. Fewer different points than k give fewer centres; points without a
    vector take no part, none at all is an error.
    """
    if k > MAX_PROTOTYPES:
        raise ValueError(f"more than {MAX_PROTOTYPES} prototypes")
    given = points.where(F.col(vector).isNotNull()).select(key, F.transform(vector, lambda x: x.cast("double")).alias(vector))
    best: dict | None = None
    for start in range(restarts):
        uniform = (F.pmod(F.xxhash64(key, F.lit(seed), F.lit(start)), F.lit(2**40)) + 1) / F.lit(2.0**40)
        first = given.agg(F.min_by(vector, F.struct(uniform, key)).alias("c")).first().c
        if first is None:
            raise ValueError("no points")
        centres = [list(first)]
        while len(centres) < k:
            far = _nearest(given, key, vector, centres).where("d > 0")
            # the least of -ln(u) / d is a draw in proportion to d
            drawn = far.agg(F.min_by(vector, F.struct((-F.ln(F.pmod(F.xxhash64(key, F.lit(seed), F.lit(start), F.lit(len(centres))), F.lit(2**40)) / F.lit(2.0**40) + 1e-13) / F.col("d")), key)).alias("c")).first().c
            if drawn is None:
                break
            centres.append(list(drawn))
        rounds, inertia = 0, float("inf")
        while rounds < most:
            rounds += 1
            own = _nearest(given, key, vector, centres)
            flat = own.select("cluster", "d", F.posexplode(vector).alias("pos", "x")).groupBy("cluster", "pos").agg(F.avg("x").alias("m"), F.sum(F.when(F.col("pos") == 0, F.col("d"))).alias("d"))
            means = {r.cluster: r for r in flat.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("m"), F.sum("d").alias("d")).collect()}
            now = sum(r.d for r in means.values())
            new = [[p.m for p in means[i].m] if i in means else None for i in range(len(centres))]
            empty = [i for i, c in enumerate(new) if c is None]
            if empty:
                lost = own.orderBy(F.desc("d"), key).limit(len(empty)).collect()
                for i, r in zip(empty, lost):
                    new[i] = list(r[vector])
                new = [c if c is not None else old for c, old in zip(new, centres)]
            if now >= inertia - 1e-12 and not empty:
                break
            inertia, centres = now, new
        if best is None or inertia < best["inertia"] - 1e-12:
            best = {"centres": centres, "inertia": inertia, "rounds": rounds}
    return best


def scatter_mean(messages: DataFrame, keys: list[str], value: str) -> DataFrame:
    return messages.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("messages"))


def carried_state(df: DataFrame, node: str, time: str, value: str, active: str) -> DataFrame:
    """``df`` with ``state``: the value where active, otherwise that of the last active snapshot of the node."""
    last = F.last(F.when(F.col(active), F.col(value)), ignorenulls=True).over(W.partitionBy(node).orderBy(time).rowsBetween(W.unboundedPreceding, W.currentRow))
    return df.withColumn("state", last)


def masked_fusion(scores: list[Column], available: list[Column], values: list[Column], fallback: Column) -> Column:
    """Softmax over the available scores, applied to the values; ``fallback`` if nothing is available."""
    top = F.greatest(*[F.when(a, s) for s, a in zip(scores, available)], F.lit(-1e300))
    weights = [F.when(a, F.exp(s - top)).otherwise(F.lit(0.0)) for s, a in zip(scores, available)]
    total = sum(weights[1:], weights[0])
    mixed = [w * v for w, v in zip(weights, values)]
    return F.when(total > 0, sum(mixed[1:], mixed[0]) / total).otherwise(fallback)


def bce_with_logits(logit: Column, label: Column) -> Column:
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def weighted_loss(parts: dict[str, tuple[float, DataFrame]]) -> DataFrame:
    """One row: each part's loss and ``total``, their weighted sum; a part is a table of one row and one column. A part without a value counts as nothing."""
    names = list(parts)
    one = None
    for name in names:
        row = parts[name][1].toDF(name)
        one = row if one is None else one.join(row, F.lit(True))
    terms = [F.lit(float(parts[n][0])) * F.coalesce(F.col(n), F.lit(0.0)) for n in names]
    return one.select(*names, sum(terms[1:], terms[0]).alias("total"))


def semantic_loss(df: DataFrame, a: str, b: str, mask: str) -> DataFrame:
    """Mean of 1 - cosine over masked rows, 0 if there are none: one row."""
    return df.agg(F.coalesce(F.avg(F.when(F.col(mask), 1 - cosine(F.col(a), F.col(b)))), F.lit(0.0)).alias("loss"))


def time_split(snapshot: Column, train: int = 24, validation: int = 5) -> Column:
    return F.when(snapshot < train, "train").when(snapshot < train + validation, "validation").otherwise("test")


def time_window(snapshot: Column, length: int = 3) -> Column:
    return F.floor(snapshot / length).cast("int")


# -- metrics of partitions ---------------------------------------------------------------------------


def _sides(edge: DataFrame, partition: DataFrame) -> DataFrame:
    u = partition.select("snapshot_id", F.col("node_index").alias("src_index"), F.col("community").alias("cu"))
    v = partition.select("snapshot_id", F.col("node_index").alias("dst_index"), F.col("community").alias("cv"))
    return edge.join(u, ["snapshot_id", "src_index"]).join(v, ["snapshot_id", "dst_index"])


def directed_modularity(edge: DataFrame, partition: DataFrame, weight: str = "count_raw") -> DataFrame:
    """Directed weighted modularity per snapshot and relation; no row without weight."""
    k = ["snapshot_id", "relation_id"]
    flow = _sides(edge, partition).groupBy(*k, "cu", "cv").agg(F.sum(weight).cast("double").alias("w"))
    total = flow.groupBy(*k).agg(F.sum("w").alias("t"), F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0)).alias("inside"))
    out = flow.groupBy(*k, F.col("cu").alias("c")).agg(F.sum("w").alias("o"))
    into = flow.groupBy(*k, F.col("cv").alias("c")).agg(F.sum("w").alias("i"))
    expected = out.join(into, [*k, "c"]).groupBy(*k).agg(F.sum(F.col("o") * F.col("i")).alias("e"))
    return total.join(expected, k, "left").where("t > 0").select(*k, (F.col("inside") / F.col("t") - F.coalesce("e", F.lit(0.0)) / (F.col("t") * F.col("t"))).alias("modularity"))


def conductance(edge: DataFrame, partition: DataFrame, weight: str = "count_raw") -> DataFrame:
    """Per snapshot and community: volume, cut and cut / min(volume, rest), edges taken in both directions."""
    k = ["snapshot_id"]
    both = _sides(edge, partition).groupBy(*k, "cu", "cv").agg(F.sum(weight).cast("double").alias("w"))
    ends = both.select(*k, F.explode(F.array(F.struct(F.col("cu").alias("c"), F.col("cv").alias("d")), F.struct(F.col("cv").alias("c"), F.col("cu").alias("d")))).alias("p"), "w").select(*k, "p.*", "w")
    per = ends.groupBy(*k, "c").agg(F.sum("w").alias("volume"), F.sum(F.when(F.col("c") != F.col("d"), F.col("w")).otherwise(0.0)).alias("cut"))
    whole = per.groupBy(*k).agg(F.sum("volume").alias("all"))
    least = F.least(F.col("volume"), F.col("all") - F.col("volume"))
    return per.join(whole, k).select(*k, F.col("c").alias("community"), "volume", "cut", F.when(least > 0, F.col("cut") / least).otherwise(0.0).alias("conductance"))


def contingency(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of (u, v) over the keys that both partitions have."""
    return a.select(*keys, F.col("community").alias("u")).join(b.select(*keys, F.col("community").alias("v")), keys).groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"))


def expected_mutual_information(a: int, b: int, n: int) -> float:
    """What a part of ``a`` and a part of ``b`` of ``n`` things add to the mutual information of random partitions, per pair of parts.

    The number in common is hypergeometric; its probabilities follow from the one at the mode by ratios, and those
    that cannot change a double are left out, so long ranges cost little.
    """
    low, high = max(1, a + b - n), min(a, b)
    if low > high:
        return 0.0
    mode = min(max((a + 1) * (b + 1) // (n + 2), low), high)
    spread = math.sqrt(max(a * b / n * (1 - a / n) * (1 - b / n), 1.0))
    low, high = max(low, int(mode - 40 * spread - 50)), min(high, int(mode + 40 * spread + 50))
    g = math.lgamma
    top = g(a + 1) + g(b + 1) + g(n - a + 1) + g(n - b + 1) - g(n + 1) - g(mode + 1) - g(a - mode + 1) - g(b - mode + 1) - g(n - a - b + mode + 1)
    up = np.arange(mode, high, dtype=np.float64)
    down = np.arange(mode, low, -1, dtype=np.float64)
    above = top + np.cumsum(np.log((a - up) * (b - up) / ((up + 1) * (n - a - b + up + 1)))) if len(up) else up
    below = top + np.cumsum(np.log(down * (n - a - b + down) / ((a - down + 1) * (b - down + 1)))) if len(down) else down
    i = np.concatenate([[mode], up + 1, down - 1])
    log_p = np.concatenate([[top], above, below])
    return float((i / n * np.log(n * i / (float(a) * b)) * np.exp(log_p)).sum())


def partition_agreement(table: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """From a contingency table, n, entropies, mutual information, NVI, AMI (arithmetic mean) and ARI: one row, or one per ``keys``.

    The expected mutual information sums over pairs of distinct sizes, of which a partition of N
    things has fewer than the root of 2 N; each pair is computed on its own.
    """
    ship(table.sparkSession)
    k = keys or []
    n = F.col("n").cast("double")
    rows = table.groupBy(*k, "u").agg(F.sum("n").alias("a"))
    cols = table.groupBy(*k, "v").agg(F.sum("n").alias("b"))
    total = table.groupBy(*k).agg(F.sum("n").cast("double").alias("big"))

    def meet(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
        return left.join(right, [*k, *more]) if k or more else left.join(right, F.lit(True))

    def entropy(df: DataFrame, c: str, name: str, pairs: str) -> DataFrame:
        share = F.col(c) / F.col("big")
        return meet(df, total).groupBy(*k).agg((-F.sum(share * F.ln(share))).alias(name), F.sum(F.col(c) * (F.col(c) - 1) / 2).alias(pairs))

    both = meet(meet(meet(table, rows, "u"), cols, "v"), total)
    mi = both.groupBy(*k).agg(F.sum(n / F.col("big") * F.ln(n * F.col("big") / (F.col("a") * F.col("b")))).alias("mi"), F.sum(n * (n - 1) / 2).alias("pairs"))

    @F.arrow_udf("double")
    def each(a: pa.Array, b: pa.Array, big: pa.Array) -> pa.Array:
        return pa.array([expected_mutual_information(x, y, z) for x, y, z in zip(a.to_pylist(), b.to_pylist(), big.to_pylist())], pa.float64())

    sizes_a = rows.groupBy(*k, "a").agg(F.count(F.lit(1)).cast("double").alias("ka"))
    sizes_b = cols.groupBy(*k, "b").agg(F.count(F.lit(1)).cast("double").alias("kb"))
    listed = sizes_b.groupBy(*k).agg(F.collect_list(F.struct("b", "kb")).alias("all"))
    grid = meet(meet(sizes_a, listed), total).select(*k, "a", "ka", "big", F.explode("all").alias("s")).select(*k, "a", "ka", "big", "s.*")
    emi = grid.groupBy(*k).agg(F.sum(F.col("ka") * F.col("kb") * each("a", "b", F.col("big").cast("bigint"))).alias("e"))
    one = meet(meet(meet(meet(mi, total), entropy(rows, "a", "hu", "pa")), entropy(cols, "b", "hv", "pb")), emi)
    hu, hv, e, x = F.col("hu"), F.col("hv"), F.col("e"), F.col("mi")
    every = F.col("big") * (F.col("big") - 1) / 2
    expected = F.coalesce(F.try_divide(F.col("pa") * F.col("pb"), every), F.lit(0.0))
    return one.select(
        *k, F.col("big").alias("n"), hu.alias("entropy_u"), hv.alias("entropy_v"), "mi", F.when(hu + hv - x > 1e-15, F.try_divide(hu + hv - 2 * x, hu + hv - x)).otherwise(0.0).alias("nvi"), e.alias("expected_mi"),
        F.when(F.abs((hu + hv) / 2 - e) > 1e-15, F.try_divide(x - e, (hu + hv) / 2 - e)).otherwise(1.0).alias("ami"),
        F.coalesce(F.try_divide(F.col("pairs") - expected, (F.col("pa") + F.col("pb")) / 2 - expected), F.lit(1.0)).alias("ari"),
    )


def consecutive_agreement(partition: DataFrame) -> DataFrame:
    """Agreement of each snapshot's partition with the next one's, over the nodes that both have."""
    later = partition.select((F.col("snapshot_id") - 1).alias("snapshot_id"), "node_index", F.col("community").alias("v"))
    both = partition.select("snapshot_id", "node_index", F.col("community").alias("u")).join(later, ["snapshot_id", "node_index"])
    return partition_agreement(both.groupBy("snapshot_id", "u", "v").agg(F.count(F.lit(1)).alias("n")), ["snapshot_id"])


def stability(runs: DataFrame) -> DataFrame:
    """Mean agreement of the partitions of several runs with each other: ``runs`` has run, node_index and community.

    One row: how many pairs of runs, their mean AMI and ARI. The runs are few, so their pairs are too; nodes meet by their index.
    """
    a = runs.select(F.col("run").alias("ra"), "node_index", F.col("community").alias("u"))
    b = runs.select(F.col("run").alias("rb"), "node_index", F.col("community").alias("v"))
    table = a.join(b, "node_index").where("ra < rb").groupBy("ra", "rb", "u", "v").agg(F.count(F.lit(1)).alias("n"))
    return partition_agreement(table, ["ra", "rb"]).agg(F.count(F.lit(1)).alias("pairs"), F.avg("ami").alias("ami"), F.avg("ari").alias("ari"))


def macro_means(metric: DataFrame, value: str) -> DataFrame:
    """Mean of a metric per snapshot over its relations, and over all snapshots (snapshot_id NULL)."""
    per = metric.groupBy("snapshot_id").agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("relations"))
    whole = per.agg(F.avg(value).alias(value), F.sum("relations").alias("relations"))
    return per.unionByName(whole.select(F.lit(None).cast(dict(per.dtypes)["snapshot_id"]).alias("snapshot_id"), value, "relations"))


def conductance_summary(per_community: DataFrame) -> DataFrame:
    """Per snapshot: conductance weighted by volume, its median and its 90th percentile over communities."""
    q = F.percentile("conductance", F.array(F.lit(0.5), F.lit(0.9)))
    got = per_community.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("communities"), F.try_divide(F.sum(F.col("conductance") * F.col("volume")), F.sum("volume")).alias("weighted"), q.alias("q"))
    return got.select("snapshot_id", "communities", F.coalesce("weighted", F.lit(0.0)).alias("weighted"), F.col("q")[0].alias("median"), F.col("q")[1].alias("p90"))


def centroid_silhouette(points: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Cosine silhouette per point, exact: mean cosines to a cluster are products with its sum of unit vectors.

    With unit vectors the mean cosine distance of a point to a cluster needs only the cluster's sum
    and size, so no pairs are formed. Clusters of one point score 0.
    """
    unit_points = points.where(F.col(vector).isNotNull()).select(key, F.col(label).alias("c"), unit(F.col(vector)).alias("v"))
    sums = unit_points.select("c", F.posexplode("v").alias("pos", "x")).groupBy("c", "pos").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    packed = sums.groupBy("c").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda p: p["s"]).alias("s"))
    if packed.limit(MAX_PROTOTYPES + 1).count() > MAX_PROTOTYPES:
        raise ValueError(f"more than {MAX_PROTOTYPES} clusters")
    all_c = packed.agg(F.collect_list(F.struct("c", "n", "s")).alias("k")).scalar()
    d = lambda s, v: F.aggregate(F.zip_with(s, v, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    meet = unit_points.withColumn("_k", all_c)
    dist = F.transform(
        "_k",
        lambda k: F.struct(
            (k["c"] == F.col("c")).alias("own"),
            F.when(k["c"] == F.col("c"), F.when(k["n"] > 1, 1 - (d(k["s"], F.col("v")) - d(F.col("v"), F.col("v"))) / (k["n"] - 1))).otherwise(1 - d(k["s"], F.col("v")) / k["n"]).alias("d"),
        ),
    )
    a = F.filter("_d", lambda x: x["own"])[0]["d"]
    b = F.array_min(F.transform(F.filter("_d", lambda x: ~x["own"]), lambda x: x["d"]))
    return meet.withColumn("_d", dist).select(key, F.when(a.isNull() | b.isNull() | (F.greatest(a, b) == 0), 0.0).otherwise((b - a) / F.greatest(a, b)).alias("silhouette"))


MAX_QUERIES = 10_000


def neighbour_overlap(queries: DataFrame, points: DataFrame, key: str, vector: str, dimension: int, k: int = 10) -> DataFrame:
    """Per query the share of its ``k`` nearest by cosine that are also nearest by the first ``dimension`` numbers; the query itself does not count.

    The queries are a stated set whose size is checked; each block of points meets all of them and keeps its
    own best, so what is moved is ``k`` rows per query and block.
    """
    rows = queries.where(F.col(vector).isNotNull()).select(key, vector).limit(MAX_QUERIES + 1).toPandas()
    if len(rows) > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries")
    ids = rows[key].to_numpy()
    kind = dict(points.dtypes)[key]
    if not len(ids):
        return points.limit(0).select(key, F.lit(0.0).alias("overlap"))
    ship(points.sparkSession)
    shipped = points.sparkSession.sparkContext.broadcast((ids, np.array(rows[vector].tolist(), dtype=np.float64)))

    def best(blocks):
        names, whole = shipped.value
        for block in blocks:
            if not len(block):
                continue
            other, own = np.array(block[vector].tolist(), dtype=np.float64), block[key].to_numpy()
            for which, size in (("whole", other.shape[1]), ("part", dimension)):
                a, b = whole[:, :size], other[:, :size]
                lengths = np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
                near = np.round(np.divide(a @ b.T, lengths, out=np.zeros_like(lengths), where=lengths > 0), 9)
                near[names[:, None] == own[None, :]] = -2.0
                for q in range(len(names)):
                    order = np.lexsort((own, -near[q]))[:k]
                    order = order[near[q][order] > -2.0]
                    yield pd.DataFrame({"q": names[q], "which": which, "o": own[order], "s": near[q][order]})

    found = points.where(F.col(vector).isNotNull()).select(key, vector).mapInPandas(best, f"q {kind}, which string, o {kind}, s double")
    ranked = found.withColumn("r", F.row_number().over(W.partitionBy("q", "which").orderBy(F.desc("s"), "o"))).where(F.col("r") <= k)
    both = ranked.groupBy("q", "o").agg(F.count_distinct("which").alias("n"))
    return both.groupBy(F.col("q").alias(key)).agg((F.count_if(F.col("n") == 2) / F.lit(float(k))).alias("overlap"))


def future_links(edge: DataFrame, partition: DataFrame, relations: int = 4) -> DataFrame:
    """Average precision of predicting the next snapshot's new links by block rates, per snapshot and relation.

    The score of a block (community, community) is its Laplace-smoothed share of linked pairs; pairs of
    a block tie, so precision is computed on blocks in order of score, exactly, without listing pairs.
    """
    members = partition.groupBy("snapshot_id", "community").agg(F.count(F.lit(1)).cast("double").alias("m"))
    now = edge.select("snapshot_id", "relation_id", "src_index", "dst_index").distinct()
    k = ["snapshot_id", "relation_id", "cu", "cv"]
    old = _sides(now, partition).groupBy(*k).agg(F.count(F.lit(1)).cast("double").alias("links"))
    later = edge.select((F.col("snapshot_id") - 1).alias("snapshot_id"), "relation_id", "src_index", "dst_index").distinct().join(now, ["snapshot_id", "relation_id", "src_index", "dst_index"], "left_anti")
    new = _sides(later, partition).groupBy(*k).agg(F.count(F.lit(1)).cast("double").alias("hits"))
    rel = now.select("snapshot_id", F.col("relation_id")).distinct()
    # blocks with links now or later, one by one
    seen = old.join(new, k, "full").join(rel, ["snapshot_id", "relation_id"], "left_semi").fillna(0.0, ["links", "hits"])
    size = lambda c, m: members.select("snapshot_id", F.col("community").alias(c), F.col("m").alias(m))
    same = (F.col("cu") == F.col("cv")).alias("same")
    pairs = F.when(F.col("same"), F.col("mu") * (F.col("mv") - 1)).otherwise(F.col("mu") * F.col("mv"))
    sized = seen.join(size("cu", "mu"), ["snapshot_id", "cu"]).join(size("cv", "mv"), ["snapshot_id", "cv"]).select("snapshot_id", "relation_id", "mu", "mv", same, "links", "hits").withColumn("pairs", pairs)
    # all others of a kind score alike, so they are counted by the sizes of their communities
    kinds = members.groupBy("snapshot_id", "m").agg(F.count(F.lit(1)).cast("double").alias("h"))
    left, right = kinds.select("snapshot_id", F.col("m").alias("mu"), F.col("h").alias("hu")), kinds.select("snapshot_id", F.col("m").alias("mv"), F.col("h").alias("hv"))
    apart = left.join(right, "snapshot_id").select("snapshot_id", "mu", "mv", F.lit(False).alias("same"), (F.col("hu") * F.col("hv") - F.when(F.col("mu") == F.col("mv"), F.col("hu")).otherwise(0.0)).alias("blocks"))
    every = apart.unionByName(left.select("snapshot_id", "mu", F.col("mu").alias("mv"), F.lit(True).alias("same"), F.col("hu").alias("blocks"))).join(rel, "snapshot_id")
    kind = ["snapshot_id", "relation_id", "mu", "mv", "same"]
    used = sized.groupBy(*kind).agg(F.count(F.lit(1)).cast("double").alias("used"))
    rest = every.join(used, kind, "left").withColumn("pairs", pairs).select("snapshot_id", "relation_id", "pairs", (F.col("blocks") - F.coalesce("used", F.lit(0.0))).alias("blocks")).where("blocks > 0 and pairs > 0")
    score = lambda links: F.round((links + 1) / (F.col("pairs") + 2), 12).alias("score")
    scored = sized.select("snapshot_id", "relation_id", (F.col("pairs") - F.col("links")).alias("free"), "hits", score(F.col("links"))).where("free > 0").unionByName(
        rest.select("snapshot_id", "relation_id", (F.col("blocks") * F.col("pairs")).alias("free"), F.lit(0.0).alias("hits"), score(F.lit(0.0)))
    )
    tied = scored.groupBy("snapshot_id", "relation_id", "score").agg(F.sum("free").alias("free"), F.sum("hits").alias("hits"))
    w = W.partitionBy("snapshot_id", "relation_id").orderBy(F.desc("score"))
    cum = tied.withColumns({"tp": F.sum("hits").over(w), "seen": F.sum("free").over(w)})
    got = cum.groupBy("snapshot_id", "relation_id").agg(F.sum("hits").alias("new_links"), F.sum(F.col("hits") * F.col("tp") / F.col("seen")).alias("weighted"))
    return got.where("new_links > 0").select("snapshot_id", "relation_id", F.col("new_links").cast("bigint").alias("new_links"), (F.col("weighted") / F.col("new_links")).alias("average_precision"))


def collapse_flags(partition: DataFrame, clusters: int, near_uniform: float = 0.999) -> DataFrame:
    """Per snapshot: used clusters, the largest share, entropy of sizes, clusters nobody is in, and whether the partition has collapsed."""
    sizes = partition.groupBy("snapshot_id", "community").agg(F.count(F.lit(1)).cast("double").alias("n"))
    t = sizes.groupBy("snapshot_id").agg(F.sum("n").alias("t"), F.max("n").alias("x"), F.count(F.lit(1)).alias("used"), (-F.sum(F.col("n") * F.ln("n"))).alias("nl"))
    h = F.ln("t") + F.col("nl") / F.col("t")
    return t.select("snapshot_id", "used", (F.col("x") / F.col("t")).alias("largest_share"), h.alias("entropy"), (F.lit(clusters) - F.col("used")).alias("empty_communities"), ((F.col("used") == 1) | ((F.lit(clusters) > 1) & (h >= near_uniform * F.ln(F.lit(float(clusters)))))).alias("collapsed"))


def activity_features(edge: DataFrame) -> DataFrame:
    """Diagnostic features per snapshot and node: reciprocity of its links, share of each relation, their entropy."""
    pairs = edge.groupBy("snapshot_id", "src_index", "dst_index").agg(F.sum("count_raw").alias("w"))
    back = pairs.select("snapshot_id", F.col("dst_index").alias("src_index"), F.col("src_index").alias("dst_index"), F.lit(1).alias("b"))
    mutual = pairs.join(back, ["snapshot_id", "src_index", "dst_index"], "left").groupBy("snapshot_id", F.col("src_index").alias("node_index")).agg(F.avg(F.coalesce("b", F.lit(0)).cast("double")).alias("reciprocity"))
    by = edge.groupBy("snapshot_id", F.col("src_index").alias("node_index"), "relation_id").agg(F.sum("count_raw").cast("double").alias("w"))
    t = by.groupBy("snapshot_id", "node_index").agg(F.sum("w").alias("t"), (-F.sum(F.col("w") * F.ln("w"))).alias("wl"))
    mixed = t.select("snapshot_id", "node_index", (F.ln("t") + F.col("wl") / F.col("t")).alias("relation_entropy"))
    return mutual.join(mixed, ["snapshot_id", "node_index"])
