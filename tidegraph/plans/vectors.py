"""Queries of the vector, model and metric operators, of the streams, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidegraph.config import DEFAULT, FEATURES, RELATIONS
from tidegraph.functions.vectors import norm, truncated_unit
from tidegraph.operators import graph, model, pooling, validate
from tidegraph.operators.skew import account_key
from tidegraph.plans.core import EDGES, TWEETS, _DEGREES, _T, _X, edges_of, events, tweets
from tidegraph.session import shared_dir, written
from tidegraph.sources.tables import table
from tidegraph.streaming import ingest

QUERIES = {}
SQL = {}
T, N, D = DEFAULT.snapshots, 10, 64


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def units(spark, d):
    """The embeddings as unit vectors of nodes (label) and snapshots (vec_id modulo the calendar)."""
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.col("label").alias("node_index"), F.pmod("vec_id", F.lit(T)).cast("int").alias("snapshot_id"), "embedding")


def flat(df, keys, vector="vector", digits=6):
    """A vector as one row per place, which compares across engines."""
    return df.select(*keys, F.posexplode(vector).alias("pos", "x")).select(*keys, "pos", (F.round(F.col("x").cast("double"), digits) + 0.0).alias("x"))


def centres(spark, d):
    """The mean vector of each label, as prototypes."""
    return pooling.mean_pool(units(spark, d), ["node_index"]).select(F.col("node_index").alias("cluster"), F.col("vector").alias("mu"))


U = f"""u AS (SELECT vec_id, label AS node_index, CAST(vec_id % {T} AS INTEGER) AS snapshot_id, embedding FROM embeddings),
f AS (SELECT vec_id, node_index, snapshot_id, CAST(i AS INTEGER) AS pos, CAST(embedding[i + 1] AS DOUBLE) AS x FROM u, range({D}) t(i)),
m AS (SELECT node_index AS cluster, pos, avg(x) AS mx FROM f GROUP BY ALL)"""
Q = f"""{U}, d2 AS (SELECT f.vec_id, m.cluster, sum((f.x - m.mx) * (f.x - m.mx)) AS d FROM f JOIN m ON m.pos = f.pos GROUP BY ALL), w AS (SELECT vec_id, cluster, 1 / (1 + d) AS w, d FROM d2),
q AS (SELECT vec_id, cluster, w / sum(w) OVER (PARTITION BY vec_id) AS q FROM w)"""
P = f"""{Q}, ff AS (SELECT cluster, sum(q * q) AS f FROM q GROUP BY 1), r AS (SELECT q.vec_id, q.cluster, q, q * q / f AS r FROM q JOIN ff ON ff.cluster = q.cluster), p AS (SELECT vec_id, cluster, q, r / sum(r) OVER (PARTITION BY vec_id) AS p FROM r)"""


def soft(spark, d):
    return model.student_t(units(spark, d), centres(spark, d), "vec_id", "embedding")


# -- pooling -----------------------------------------------------------------------------------------


@query(f"WITH {U} SELECT snapshot_id, node_index, pos, round(avg(x), 6) AS x FROM f GROUP BY ALL")
def pool_node_snapshot(spark, d):
    return flat(pooling.mean_pool(units(spark, d), ["snapshot_id", "node_index"]), ["snapshot_id", "node_index"])


@query(f"WITH {U}, g AS (SELECT CAST(s AS INTEGER) AS snapshot_id, CAST(n AS INTEGER) AS node_index FROM range({T}) a(s), range({N}) b(n)), c AS (SELECT snapshot_id, node_index, count(*) AS k FROM u GROUP BY ALL) SELECT g.snapshot_id, g.node_index, coalesce(k, 0) AS valid_count, k IS NOT NULL AS available, CAST({D} AS INTEGER) AS size FROM g LEFT JOIN c USING (snapshot_id, node_index)")
def pool_masks(spark, d):
    grid = spark.range(T * N).select(F.floor(F.col("id") / N).cast("int").alias("snapshot_id"), (F.col("id") % N).cast("int").alias("node_index"))
    pooled = pooling.mean_pool(units(spark, d), ["snapshot_id", "node_index"])
    return pooling.node_vectors(pooled, grid, D).select("snapshot_id", "node_index", "valid_count", "available", F.size("vector").alias("size"))


@query(f"WITH {U} SELECT vec_id, round(sqrt(sum(x * x)), 6) AS norm FROM f GROUP BY 1")
def unit_norms(spark, d):
    return units(spark, d).select("vec_id", F.round(norm(F.col("embedding")), 6).alias("norm"))


@query(f"WITH {U}, n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM f WHERE pos < 16 GROUP BY 1) SELECT f.vec_id, pos, round(x / n, 6) AS x FROM f JOIN n ON n.vec_id = f.vec_id WHERE pos < 16")
def mrl_truncate_l2(spark, d):
    return flat(units(spark, d).select("vec_id", truncated_unit(F.col("embedding"), 16).alias("vector")), ["vec_id"])


@query(f"WITH {U}, n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM f GROUP BY 1) SELECT CASE WHEN abs(n - 1) > 1e-3 THEN 'off' ELSE 'unit' END AS kind, count(*) AS vectors FROM n GROUP BY 1")
def norm_check(spark, d):
    n = norm(F.col("embedding"))
    return units(spark, d).groupBy(F.when(F.abs(n - 1) > 1e-3, "off").otherwise("unit").alias("kind")).agg(F.count(F.lit(1)).alias("vectors"))


@query(f"WITH {EDGES} SELECT snapshot_id, relation_id, src_index, dst_index, max(c) AS events_with_text FROM (SELECT e.*, (SELECT count(*) FROM ev WHERE ev.snapshot_id = e.snapshot_id AND ev.relation_id = e.relation_id AND ev.source_idx = e.src_index AND ev.target_idx = e.dst_index AND ev.text_quality = 'ok') AS c FROM e) GROUP BY ALL")
def edge_text_counts(spark, d):
    """Events with text per canonical edge, zero where there is none."""
    e = events(spark, d)
    n = e.where("text_quality = 'ok'").groupBy("snapshot_id", "relation_id", F.col("source_idx").alias("src_index"), F.col("target_idx").alias("dst_index")).agg(F.count(F.lit(1)).alias("n"))
    return graph.edges(e).join(n, graph.EDGE, "left").select(*graph.EDGE, F.coalesce("n", F.lit(0)).alias("events_with_text"))


_UP = lambda name, source, keys: f", {name} AS (SELECT snapshot_id, relation_id{keys}, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h, chr(10) ORDER BY place)) AS h FROM {source} GROUP BY snapshot_id, relation_id{keys})"


@query(
    f"WITH {EDGES}, f0 AS (SELECT snapshot_id, relation_id, src_index, dst_index // {pooling.FAN} AS d, dst_index AS place, snapshot_id || ',' || relation_id || ',' || src_index || ',' || dst_index AS h, 1 AS n FROM e)"
    + _UP("f1", "f0", ", src_index, d") + _UP("f2", f"(SELECT * EXCLUDE (d), d AS place, d // {pooling.FAN} AS d FROM f1)", ", src_index, d") + _UP("f3", "(SELECT *, d AS place FROM f2)", ", src_index")
    + _UP("f4", f"(SELECT *, src_index AS place, src_index // {pooling.FAN} AS s FROM f3)", ", s") + _UP("f5", f"(SELECT * EXCLUDE (s), s AS place, s // {pooling.FAN} AS s FROM f4)", ", s")
    + _UP("f6", "(SELECT *, s AS place FROM f5)", "") + " SELECT snapshot_id, relation_id, n AS edges, h AS fingerprint FROM f6"
)
def edge_order_fingerprint(spark, d):
    return pooling.order_fingerprint(edges_of(spark, d))


@query(f"WITH {U} SELECT 'wrong_size' AS problem, count(*) AS vectors FROM u WHERE len(embedding) <> {D} HAVING count(*) > 0")
def vector_gate(spark, d):
    return validate.vector_violations(units(spark, d), "vec_id", "embedding", D).groupBy("problem").agg(F.count(F.lit(1)).alias("vectors"))


# -- model -------------------------------------------------------------------------------------------

_XS = f"WITH {EDGES}{TWEETS}{_DEGREES}{_X}, lg AS (" + " UNION ALL ".join(f"SELECT snapshot_id, node_index, '{c}' AS feature, {c} AS x FROM xs" for c in FEATURES) + "), sc AS (SELECT feature, quantile_cont(x, 0.5) AS median, CASE WHEN quantile_cont(x, 0.75) - quantile_cont(x, 0.25) < 1e-12 THEN 1.0 ELSE quantile_cont(x, 0.75) - quantile_cont(x, 0.25) END AS scale FROM lg GROUP BY 1)"


def features(spark, d):
    x = graph.structural_features(edges_of(spark, d), tweets(spark, d))
    return x.withColumns({f: F.round(f, 6) for f in FEATURES})


@query(_XS + " SELECT feature, round(median, 6) AS median, round(scale, 6) AS scale FROM sc")
def robust_scaler_fit(spark, d):
    """The scaler of all structural features."""
    return model.robust_scaler(features(spark, d), list(FEATURES)).select("feature", F.round("median", 6).alias("median"), F.round("scale", 6).alias("scale"))


@query(_XS + " SELECT lg.snapshot_id, lg.node_index, " + ", ".join(f"round(max(CASE WHEN lg.feature = '{c}' THEN (x - median) / scale END), 6) AS {c}" for c in FEATURES) + " FROM lg JOIN sc ON sc.feature = lg.feature GROUP BY ALL")
def robust_scaled(spark, d):
    x = features(spark, d)
    done = model.robust_scaled(x, list(FEATURES), model.robust_scaler(x, list(FEATURES)), "struct_active")
    return done.select("snapshot_id", "node_index", *[F.round(c, 6).alias(c) for c in FEATURES])


@query(f"WITH {Q} SELECT vec_id, cluster, round(q, 6) AS q FROM q")
def student_t_q(spark, d):
    return soft(spark, d).withColumn("q", F.round("q", 6))


@query(f"WITH {Q} SELECT vec_id, arg_max(cluster, q) AS cluster, round(max(q), 6) AS confidence, round(-sum(q * ln(q)), 6) AS entropy FROM q GROUP BY 1")
def community_assignment(spark, d):
    a = model.assignments(soft(spark, d), "vec_id")
    return a.select("vec_id", "cluster", F.round("confidence", 6).alias("confidence"), F.round("entropy", 6).alias("entropy"))


@query(f"WITH {P} SELECT vec_id, cluster, round(p, 6) AS p FROM p")
def dec_target(spark, d):
    return model.dec_target(soft(spark, d), "vec_id").select("vec_id", "cluster", F.round("p", 6).alias("p"))


@query(f"WITH {P} SELECT round(avg(kl), 6) AS kl FROM (SELECT vec_id, sum(p * ln(p / q)) AS kl FROM p GROUP BY 1)")
def cluster_kl(spark, d):
    return model.cluster_kl(model.dec_target(soft(spark, d), "vec_id"), "vec_id").select(F.round("kl", 6).alias("kl"))


@query(f"WITH {U}, d AS (SELECT a.cluster AS a, b.cluster AS b, sum((a.mx - b.mx) * (a.mx - b.mx)) AS d FROM m a JOIN m b ON a.pos = b.pos AND a.cluster <> b.cluster GROUP BY ALL) SELECT round(avg(greatest(0, 2.0 - d)), 6) AS separation FROM d")
def proto_separation(spark, d):
    return model.prototype_separation(centres(spark, d), 2.0).select(F.round("separation", 6).alias("separation"))


@query(f"WITH {P} SELECT round(avg(j), 6) AS js FROM (SELECT vec_id, sum(0.5 * p * ln(p / ((p + q) / 2)) + 0.5 * q * ln(q / ((p + q) / 2))) AS j FROM p GROUP BY 1)")
def js_divergence(spark, d):
    t = model.dec_target(soft(spark, d), "vec_id")
    return model.mean_js(t.select("vec_id", "cluster", "p"), t.select("vec_id", "cluster", "q"), ["vec_id"], "cluster").select(F.round("js", 6).alias("js"))


@query(f"WITH {Q}, o AS (SELECT vec_id, arg_min(cluster, d) AS c FROM w GROUP BY 1) SELECT o.c AS cluster, pos, round(avg(x), 6) AS x FROM f JOIN o ON o.vec_id = f.vec_id GROUP BY ALL")
def kmeans_step(spark, d):
    return flat(model.kmeans_step(units(spark, d), centres(spark, d), "vec_id", "embedding"), ["cluster"], "centre")


@query(f"WITH {EDGES} SELECT snapshot_id, relation_id, dst_index, round(avg(weight_log1p), 6) AS mean, count(*) AS messages FROM e GROUP BY ALL")
def scatter_mean(spark, d):
    m = model.scatter_mean(edges_of(spark, d), ["snapshot_id", "relation_id", "dst_index"], "weight_log1p")
    return m.withColumn("mean", F.round("mean", 6))


@query(
    f"WITH {EDGES}{TWEETS}, g AS (SELECT DISTINCT node_index FROM tw), c AS (SELECT g.node_index, CAST(s AS INTEGER) AS snapshot_id, tweet_count FROM g CROSS JOIN range({T}) t(s) LEFT JOIN tw ON tw.node_index = g.node_index AND tw.snapshot_id = s) "
    "SELECT node_index, snapshot_id, last_value(tweet_count IGNORE NULLS) OVER (PARTITION BY node_index ORDER BY snapshot_id ROWS UNBOUNDED PRECEDING) AS state FROM c"
)
def state_carry(spark, d):
    t = tweets(spark, d)
    every = t.select("node_index").distinct().select("node_index", F.explode(F.sequence(F.lit(0), F.lit(T - 1))).alias("snapshot_id"))
    grid = every.join(t, ["node_index", "snapshot_id"], "left").withColumn("active", F.col("tweet_count").isNotNull())
    return model.carried_state(grid, "node_index", "snapshot_id", "tweet_count", "active").select("node_index", "snapshot_id", "state")


@query(f"WITH {U}, n AS (SELECT vec_id, sqrt(sum(x * x)) AS nn, max(node_index) AS c FROM f GROUP BY 1), k AS (SELECT cluster, sqrt(sum(mx * mx)) AS nk FROM m GROUP BY 1) SELECT round(avg(1 - s / (nn * nk)), 6) AS loss FROM (SELECT f.vec_id, sum(x * mx) AS s FROM f JOIN m ON m.cluster = f.node_index AND m.pos = f.pos GROUP BY 1) z JOIN n ON n.vec_id = z.vec_id JOIN k ON k.cluster = n.c")
def semantic_loss(spark, d):
    """Cosine loss between every vector there is and its label's mean."""
    j = units(spark, d).join(centres(spark, d), F.col("node_index") == F.col("cluster")).withColumn("on", F.col("embedding").isNotNull())
    return model.semantic_loss(j, "embedding", "mu", "on").select(F.round("loss", 6).alias("loss"))


@query(f"WITH {EDGES}, z AS (SELECT weight_log1p - 1 AS l, CASE WHEN count_raw > 1 THEN 1.0 ELSE 0.0 END AS y FROM e) SELECT round(avg(greatest(l, 0) - l * y + ln(1 + exp(-abs(l)))), 6) AS bce FROM z")
def structural_bce(spark, d):
    e = edges_of(spark, d)
    return e.agg(F.round(F.avg(model.bce_with_logits(F.col("weight_log1p") - 1, (F.col("count_raw") > 1).cast("double"))), 6).alias("bce"))


_FUSED = tuple(enumerate((0.5, 0.0, -0.5, -1.0)))  # one score per relation


@query(
    f"WITH {EDGES}{_DEGREES}, v AS (SELECT snapshot_id, node_index, " + ", ".join(f"max(CASE WHEN relation_id = {i} THEN out_degree END) AS v{i}" for i, _ in _FUSED) + " FROM dg WHERE out_degree > 0 GROUP BY ALL) "
    "SELECT snapshot_id, node_index, round(CASE WHEN coalesce(v0, v1, v2, v3) IS NULL THEN -1 ELSE (" + " + ".join(f"coalesce(exp({s}) * v{i}, 0)" for i, s in _FUSED) + ") / (" + " + ".join(f"CASE WHEN v{i} IS NULL THEN 0 ELSE exp({s}) END" for i, s in _FUSED) + ") END, 6) AS fused FROM v"
)
def relation_fusion(spark, d):
    """Out-degrees of all relations fused by a masked softmax with fixed scores."""
    pick = lambda i: F.max(F.when(F.col("relation_id") == i, F.col("out_degree"))).cast("double")
    v = graph.degrees(edges_of(spark, d)).where("out_degree > 0").groupBy("snapshot_id", "node_index").agg(*[pick(i).alias(f"v{i}") for i in range(len(RELATIONS))])
    cols = [F.col(f"v{i}") for i in range(len(RELATIONS))]
    fused = model.masked_fusion([F.lit(s) for _, s in _FUSED], [c.isNotNull() for c in cols], [F.coalesce(c, F.lit(0.0)) for c in cols], F.lit(-1.0))
    return v.select("snapshot_id", "node_index", F.round(fused, 6).alias("fused"))


@query(f"WITH {EDGES} SELECT CASE WHEN snapshot_id < 24 THEN 'train' WHEN snapshot_id < 29 THEN 'validation' ELSE 'test' END AS split, CAST(snapshot_id // 3 AS INTEGER) AS \"window\", count(*) AS edges FROM e GROUP BY ALL")
def time_split(spark, d):
    e = edges_of(spark, d)
    return e.groupBy(model.time_split(F.col("snapshot_id")).alias("split"), model.time_window(F.col("snapshot_id")).alias("window")).agg(F.count(F.lit(1)).alias("edges"))


# -- metrics of partitions ---------------------------------------------------------------------------

PART = ", pt AS (SELECT DISTINCT snapshot_id, node_index, node_index % 7 AS community FROM (SELECT snapshot_id, src_index AS node_index FROM e UNION SELECT snapshot_id, dst_index FROM e)), sd AS (SELECT e.*, src_index % 7 AS cu, dst_index % 7 AS cv FROM e)"


def partition(edge):
    """A hard partition of the nodes of some edges into seven communities by index."""
    n = edge.select("snapshot_id", F.explode(F.array("src_index", "dst_index")).alias("node_index")).distinct()
    return n.withColumn("community", F.col("node_index") % 7)


def edges_once(spark, d):
    """The edges as a written table, for queries that use them several times."""
    return written(edges_of(spark, d), "edges")


@query(
    f"WITH {EDGES}{PART}, fl AS (SELECT snapshot_id, relation_id, cu, cv, CAST(sum(count_raw) AS DOUBLE) AS w FROM sd GROUP BY ALL), t AS (SELECT snapshot_id, relation_id, sum(w) AS t, sum(CASE WHEN cu = cv THEN w ELSE 0 END) AS i FROM fl GROUP BY ALL), "
    "o AS (SELECT snapshot_id, relation_id, cu AS c, sum(w) AS o FROM fl GROUP BY ALL), n AS (SELECT snapshot_id, relation_id, cv AS c, sum(w) AS n FROM fl GROUP BY ALL), x2 AS (SELECT snapshot_id, relation_id, sum(o * n) AS s FROM o JOIN n USING (snapshot_id, relation_id, c) GROUP BY ALL) "
    "SELECT t.snapshot_id, t.relation_id, round(i / t - coalesce(s, 0) / (t * t), 6) AS modularity FROM t LEFT JOIN x2 USING (snapshot_id, relation_id)"
)
def modularity_directed(spark, d):
    e = edges_once(spark, d)
    return model.directed_modularity(e, partition(e)).withColumn("modularity", F.round("modularity", 6))


@query(
    f"WITH {EDGES}{PART}, b AS (SELECT snapshot_id, cu AS c, cv AS o, count_raw AS w FROM sd UNION ALL SELECT snapshot_id, cv, cu, count_raw FROM sd), g AS (SELECT snapshot_id, c AS community, CAST(sum(w) AS DOUBLE) AS volume, CAST(sum(CASE WHEN c <> o THEN w ELSE 0 END) AS DOUBLE) AS cut FROM b GROUP BY ALL), "
    "h AS (SELECT *, sum(volume) OVER (PARTITION BY snapshot_id) AS a FROM g) SELECT snapshot_id, community, volume, cut, round(CASE WHEN least(volume, a - volume) > 0 THEN cut / least(volume, a - volume) ELSE 0 END, 6) AS conductance FROM h"
)
def conductance(spark, d):
    e = edges_once(spark, d)
    return model.conductance(e, partition(e)).withColumn("conductance", F.round("conductance", 6))


@query(
    """WITH b AS (SELECT DISTINCT """ + _T('author_account_id') + """ AS a FROM normalized_records WHERE author_account_id IS NOT NULL), n AS (SELECT node_index % 7 AS u, (node_index // 3) % 5 AS v FROM node_universe WHERE account_id IN (FROM b)),
c AS (SELECT u, v, CAST(count(*) AS DOUBLE) AS n FROM n GROUP BY ALL), r AS (SELECT u, sum(n) AS a FROM c GROUP BY 1), k AS (SELECT v, sum(n) AS b FROM c GROUP BY 1), t AS (SELECT sum(n) AS n FROM c),
mi AS (SELECT sum(c.n / t.n * ln(c.n * t.n / (a * b))) AS mi, sum(c.n * (c.n - 1) / 2) AS pairs FROM c JOIN r USING (u) JOIN k USING (v), t), hu AS (SELECT -sum(a / n * ln(a / n)) AS h FROM r, t), hv AS (SELECT -sum(b / n * ln(b / n)) AS h FROM k, t),
lf AS (SELECT i, sum(ln(greatest(i, 1))) OVER (ORDER BY i) AS l FROM t, LATERAL range(CAST(t.n AS BIGINT) + 1) g(i)),
ce AS (SELECT a, b, unnest(range(CAST(greatest(1, a + b - n) AS BIGINT), CAST(least(a, b) AS BIGINT) + 1)) AS i, n FROM r, k, t),
em AS (SELECT sum(ce.i / ce.n * ln(ce.n * ce.i / (a * b)) * exp(fa.l + fb.l + fna.l + fnb.l - fn.l - fi.l - fai.l - fbi.l - fr.l)) AS e FROM ce JOIN lf fa ON fa.i = a JOIN lf fb ON fb.i = b JOIN lf fna ON fna.i = n - a JOIN lf fnb ON fnb.i = n - b JOIN lf fn ON fn.i = n JOIN lf fi ON fi.i = ce.i JOIN lf fai ON fai.i = a - ce.i JOIN lf fbi ON fbi.i = b - ce.i JOIN lf fr ON fr.i = n - a - b + ce.i),
pa AS (SELECT sum(a * (a - 1) / 2) AS p FROM r), pb AS (SELECT sum(b * (b - 1) / 2) AS p FROM k)
SELECT t.n, round(hu.h, 6) AS entropy_u, round(hv.h, 6) AS entropy_v, round(mi, 6) AS mi, round((hu.h + hv.h - 2 * mi) / (hu.h + hv.h - mi), 6) AS nvi, round(e, 6) AS expected_mi, round((mi - e) / ((hu.h + hv.h) / 2 - e), 6) AS ami,
  round((pairs - pa.p * pb.p / (t.n * (t.n - 1) / 2)) / ((pa.p + pb.p) / 2 - pa.p * pb.p / (t.n * (t.n - 1) / 2)), 6) AS ari FROM t, mi, hu, hv, em, pa, pb"""
)
def partition_agreement(spark, d):
    """Entropies, mutual information, NVI, AMI and ARI of two partitions of the recorded authors."""
    seen = table(spark, d, "normalized_records").select(account_key(F.col("author_account_id")).alias("account_id")).distinct()
    n = table(spark, d, "node_universe").join(seen, "account_id", "left_semi")
    a = n.select("node_index", (F.col("node_index") % 7).alias("community"))
    b = n.select("node_index", (F.floor(F.col("node_index") / 3) % 5).alias("community"))
    got = model.partition_agreement(model.contingency(a, b, ["node_index"]))
    return got.select("n", *[F.round(c, 6).alias(c) for c in got.columns if c != "n"])


@query(
    f"WITH {U}, nn AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM f GROUP BY 1), v AS (SELECT f.vec_id, node_index AS c, pos, x / n AS x FROM f JOIN nn ON nn.vec_id = f.vec_id), "
    "pr AS (SELECT a.vec_id, a.c AS own, b.c AS c, a.vec_id = b.vec_id AS self, 1 - sum(a.x * b.x) AS d FROM v a JOIN v b ON a.pos = b.pos GROUP BY a.vec_id, a.c, b.vec_id, b.c), "
    "mn AS (SELECT vec_id, own, c, sum(CASE WHEN self THEN 0 ELSE d END) / nullif(count(*) - CASE WHEN own = c THEN 1 ELSE 0 END, 0) AS d FROM pr GROUP BY vec_id, own, c), "
    "ab AS (SELECT vec_id, max(CASE WHEN own = c THEN d END) AS a, min(CASE WHEN own <> c THEN d END) AS b FROM mn GROUP BY 1) SELECT vec_id, round(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM ab"
)
def silhouette_cosine(spark, d):
    return model.centroid_silhouette(units(spark, d), "vec_id", "embedding", "node_index").withColumn("silhouette", F.round("silhouette", 6))


@query(
    f"WITH {EDGES}{PART}, mb AS (SELECT snapshot_id, community AS c, CAST(count(*) AS DOUBLE) AS m FROM pt GROUP BY ALL), bl AS (SELECT a.snapshot_id, a.c AS cu, b.c AS cv, CASE WHEN a.c = b.c THEN a.m * (b.m - 1) ELSE a.m * b.m END AS pairs FROM mb a JOIN mb b USING (snapshot_id)), "
    "ol AS (SELECT snapshot_id, relation_id, cu, cv, CAST(count(*) AS DOUBLE) AS links FROM sd GROUP BY ALL), "
    "nw AS (SELECT n.snapshot_id - 1 AS snapshot_id, n.relation_id, n.src_index % 7 AS cu, n.dst_index % 7 AS cv, CAST(count(*) AS DOUBLE) AS hits FROM e n JOIN pt p ON p.snapshot_id = n.snapshot_id - 1 AND p.node_index = n.src_index JOIN pt q ON q.snapshot_id = n.snapshot_id - 1 AND q.node_index = n.dst_index "
    "ANTI JOIN e o ON o.snapshot_id = n.snapshot_id - 1 AND o.relation_id = n.relation_id AND o.src_index = n.src_index AND o.dst_index = n.dst_index GROUP BY ALL), "
    "fu AS (SELECT bl.snapshot_id, r.relation_id, pairs - coalesce(links, 0) AS free, coalesce(hits, 0) AS hits, round((coalesce(links, 0) + 1) / (pairs + 2), 12) AS score FROM bl JOIN (SELECT DISTINCT snapshot_id, relation_id FROM e) r USING (snapshot_id) LEFT JOIN ol ON ol.snapshot_id = bl.snapshot_id AND ol.relation_id = r.relation_id AND ol.cu = bl.cu AND ol.cv = bl.cv LEFT JOIN nw ON nw.snapshot_id = bl.snapshot_id AND nw.relation_id = r.relation_id AND nw.cu = bl.cu AND nw.cv = bl.cv), "
    "ti AS (SELECT snapshot_id, relation_id, score, sum(free) AS free, sum(hits) AS hits FROM fu WHERE free > 0 GROUP BY ALL), cu AS (SELECT *, sum(hits) OVER w AS tp, sum(free) OVER w AS seen FROM ti WINDOW w AS (PARTITION BY snapshot_id, relation_id ORDER BY score DESC)) "
    "SELECT snapshot_id, relation_id, CAST(sum(hits) AS BIGINT) AS new_links, round(sum(hits * tp / seen) / sum(hits), 6) AS average_precision FROM cu GROUP BY ALL HAVING sum(hits) > 0"
)
def future_link_ap(spark, d):
    e = edges_once(spark, d)
    return model.future_links(e, partition(e)).withColumn("average_precision", F.round("average_precision", 6))


@query(
    f"WITH {EDGES}{PART}, s AS (SELECT snapshot_id, community, CAST(count(*) AS DOUBLE) AS n FROM pt GROUP BY ALL), t AS (SELECT snapshot_id, sum(n) AS t, max(n) AS x, count(*) AS used, -sum(n * ln(n)) AS l FROM s GROUP BY 1) "
    "SELECT snapshot_id, used, round(x / t, 6) AS largest_share, round(ln(t) + l / t, 6) AS entropy, 7 - used AS empty_communities, used = 1 OR ln(t) + l / t >= 0.999 * ln(7) AS collapsed FROM t"
)
def collapse_flags(spark, d):
    return model.collapse_flags(partition(edges_of(spark, d)), 7).withColumns({"largest_share": F.round("largest_share", 6), "entropy": F.round("entropy", 6)})


@query(
    f"WITH {EDGES}, p AS (SELECT DISTINCT snapshot_id, src_index, dst_index FROM e), r AS (SELECT p.snapshot_id, p.src_index AS node_index, avg(CASE WHEN b.src_index IS NULL THEN 0.0 ELSE 1.0 END) AS reciprocity FROM p LEFT JOIN p b ON b.snapshot_id = p.snapshot_id AND b.src_index = p.dst_index AND b.dst_index = p.src_index GROUP BY ALL), "
    "w AS (SELECT snapshot_id, src_index AS node_index, relation_id, CAST(sum(count_raw) AS DOUBLE) AS w FROM e GROUP BY ALL), h AS (SELECT snapshot_id, node_index, ln(sum(w)) - sum(w * ln(w)) / sum(w) AS relation_entropy FROM w GROUP BY ALL) "
    "SELECT snapshot_id, node_index, round(reciprocity, 6) AS reciprocity, round(relation_entropy, 6) + 0.0 AS relation_entropy FROM r JOIN h USING (snapshot_id, node_index)"
)
def activity_features(spark, d):
    a = model.activity_features(edges_once(spark, d))
    return a.select("snapshot_id", "node_index", F.round("reciprocity", 6).alias("reciprocity"), (F.round("relation_entropy", 6) + 0.0).alias("relation_entropy"))


# -- streams -----------------------------------------------------------------------------------------


def _own_folder(spark, name):
    return f"{shared_dir(spark)}/tidegraph/{name}-{uuid.uuid4().hex}"


@query("SELECT event_id, source_file, source_row_number, relation_id FROM graph_events")
def stream_ingest_resume(spark, d):
    """The events read as a stream, committed batch by batch, then read back."""
    schema = table(spark, d, "graph_events").schema
    out = _own_folder(spark, "stream")
    keep = lambda b: b.select("event_id", "source_file", "source_row_number", "relation_id")
    for _ in range(2):  # the second run finds nothing left to do
        ingest.ingest(spark, f"{d}/graph_events.parquet*", schema, f"{out}/rows", f"{out}/checkpoint", keep)
    return ingest.committed(spark, f"{out}/rows")


@query("SELECT source_file, relation_id, count(*) AS rows FROM graph_events GROUP BY ALL")
def stream_counts(spark, d):
    schema = table(spark, d, "graph_events").schema
    return ingest.running_counts(spark, f"{d}/graph_events.parquet*", schema, ["source_file", "relation_id"], _own_folder(spark, "counts"))
