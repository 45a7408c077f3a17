"""Queries of readers, gates, commits, units and partition summaries, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidegraph.config import DEFAULT, FEATURES
from tidegraph.operators import diagnostics, graph, model, pooling, profile, records, selection, validate
from tidegraph.plans import core, vectors
from tidegraph.plans.core import _BLANK, _GROUPS, _NODE_UNITS, _T, EDGES, EVENTS, INTERACTIONS, TWEETS, _DEGREES, _EVENT_UNITS, _X, edges_of, events, nodes, tweets
from tidegraph.session import shared_dir, written
from tidegraph.sources import files, readers, sinks
from tidegraph.sources.adapters import adapter
from tidegraph.sources.tables import table

QUERIES = {}
SQL = {}
UNIVERSE = 4000
_LAST, _TOP = DEFAULT.snapshots - 1, UNIVERSE - 1


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _folder(spark, name):
    return f"{shared_dir(spark)}/tidegraph/{name}-{uuid.uuid4().hex}"


# -- readers -----------------------------------------------------------------------------------------

_NULLS = lambda columns: " ".join(f"WHEN {c} IS NULL THEN 'null_{c}'" for c in columns)
_RANGE = lambda bounds: " ".join(f"WHEN {c} NOT BETWEEN 0 AND {high} THEN 'out_of_bounds_{c}'" for c, high in bounds.items())
_PROBLEMS = "SELECT coalesce(problem, 'sound') AS problem, count(*) AS rows FROM q GROUP BY 1"


def _counted(checked):
    return checked.groupBy(F.coalesce("problem", F.lit("sound")).alias("problem")).agg(F.count(F.lit(1)).alias("rows"))


@query(f"WITH q AS (SELECT CASE {_NULLS(readers.NODE_TEXT)} {_RANGE({'node_index': _TOP, 'snapshot_id': _LAST})} END AS problem FROM normalized_records) {_PROBLEMS}")
def read_node_texts(spark, d):
    """The records as text units of nodes: what is wrong with how many."""
    return _counted(readers.node_texts(table(spark, d, "normalized_records"), UNIVERSE))


@query(
    f"WITH q AS (SELECT CASE {_NULLS(readers.EVENT_TEXT)} {_RANGE({'source_idx': _TOP, 'target_idx': _TOP, 'snapshot_id': _LAST, 'relation_id': 3})} WHEN source_idx = target_idx THEN 'self_loop' END AS problem FROM graph_events) {_PROBLEMS}"
)
def read_event_texts(spark, d):
    """The events as text units of edges: what is wrong with how many."""
    return _counted(readers.event_texts(table(spark, d, "graph_events"), UNIVERSE))


@query(f"WITH {EDGES} SELECT snapshot_id, relation_id, src_index, dst_index, count_raw, round(weight_log1p, 6) AS weight_log1p FROM e")
def read_edge_partitions(spark, d):
    """The edges written by snapshot and relation, and read again by the reader that refuses unsound ones."""
    at = _folder(spark, "edges")
    sinks.write_edges(edges_of(spark, d), at)
    back = files.canonical_edges(spark, at).withColumn("relation_id", F.col("relation_id").cast("tinyint"))
    return readers.sound(readers.edges(back, UNIVERSE)).withColumn("weight_log1p", F.round("weight_log1p", 6))


@query(f"WITH {EVENTS} SELECT signature, snapshot_id, relation_id, source_idx, target_idx, text_hash, source_file, source_row_number FROM ev")
def insert_events_twice(spark, d):
    """The events inserted twice under their signatures, the second time without effect."""
    at = _folder(spark, "events")
    e = events(spark, d).select("signature", "snapshot_id", "relation_id", "source_idx", "target_idx", "text_hash", "source_file", "source_row_number")
    for _ in range(2):
        sinks.insert_ignore(e, at, ["signature"], ["source_file", "source_row_number"])
    return spark.read.parquet(at).select(*e.columns)


def _sheet(spark, d):
    """The events as rows of a graph sheet: users and targets inside of the objects such a sheet has, times in seconds."""
    i = core.interactions(spark, d)
    blob = lambda c: F.concat(F.lit("{'id': "), c, F.lit(", 'username': None}"))
    target = F.col("target_account_id")
    inside = lambda relation: F.when(F.col("relation_id") == relation, F.concat(F.lit("{'id': 'x', 'user': "), blob(target), F.lit("}")))
    return i.select(
        "source_file", "source_row_number", F.unix_seconds(F.col("created").cast("timestamp")).cast("string").alias("created_at"), blob(F.col("author_account_id")).alias("user"), F.col("cleaned_text").alias("text"),
        F.when(F.col("relation_id") == 0, F.concat(F.lit("["), blob(target), F.lit("]"))).alias("user_mentions"), inside(1).alias("retweeted_status"), inside(2).alias("reply_status"), inside(3).alias("quoted_status"),
    )


@query(f"WITH {INTERACTIONS} SELECT CASE reason WHEN 'invalid_relation' THEN 'no_relation_target' ELSE reason END AS reason, count(*) AS rows FROM l GROUP BY 1")
def sheet_ladder_counts(spark, d):
    """What becomes of the events when they come as rows of a graph sheet, through the adapter of that form."""
    return graph.ladder_counts(adapter("graph_sheet")(_sheet(spark, d)), nodes(spark, d))


@query(f"WITH {EDGES} SELECT snapshot_id, relation_id, src_index, dst_index, count(*) AS rows FROM (SELECT CAST(snapshot_id AS INTEGER) AS snapshot_id, relation_id, source_idx AS src_index, target_idx AS dst_index FROM l WHERE reason = 'event') GROUP BY ALL")
def sheet_links(spark, d):
    """The links of a graph sheet: how many of its rows lead from one node to another, by quarter and relation."""
    i = graph.indexed(adapter("graph_sheet")(_sheet(spark, d)), nodes(spark, d)).where(graph.ladder() == "event")
    return i.groupBy("snapshot_id", "relation_id", F.col("source_idx").alias("src_index"), F.col("target_idx").alias("dst_index")).agg(F.count(F.lit(1)).alias("rows"))


# -- gates -------------------------------------------------------------------------------------------

_BROKEN = " OR ".join(f"{f} IS NULL OR isnan({f}) OR isinf({f})" for f in FEATURES)
_GATES = lambda pairs: " UNION ALL ".join(f"SELECT '{g}' AS gate, coalesce({c}, false) AS passed FROM one" for g, c in pairs)


@query(
    f"WITH {EDGES}{TWEETS}{_DEGREES}{_X}, one AS (SELECT (SELECT count(*) FROM xs WHERE snapshot_id NOT BETWEEN 0 AND {_LAST} OR node_index NOT BETWEEN 0 AND {_TOP}) AS x_outside, (SELECT count(*) FROM xs) AS x_rows, "
    f"(SELECT count(*) FROM (SELECT DISTINCT snapshot_id, node_index FROM xs)) AS x_keys, (SELECT count(*) FROM xs WHERE {_BROKEN}) AS x_broken, (SELECT count(*) FROM e WHERE src_index = dst_index) AS loops, (SELECT count(*) FROM e WHERE NOT abs(weight_log1p - ln(1 + count_raw)) <= 1e-6) AS weights, "
    f"(SELECT count(*) FROM e WHERE relation_id NOT BETWEEN 0 AND 3) AS relations, (SELECT count(*) FROM e WHERE src_index NOT BETWEEN 0 AND {_TOP} OR dst_index NOT BETWEEN 0 AND {_TOP}) AS ends, (SELECT count(*) FROM (SELECT 1 FROM e GROUP BY snapshot_id, relation_id, src_index, dst_index HAVING count(*) > 1)) AS repeated, "
    "(SELECT count(*) FROM ev) AS events, (SELECT count(*) FROM node_universe) AS nodes, (SELECT count(DISTINCT node_index) = count(*) AND min(node_index) = 0 AND max(node_index) = count(*) - 1 FROM node_universe) AS contiguous) "
    + _GATES([("x_struct_shape", "x_outside = 0"), ("mask_shape", "x_rows = x_keys"), ("x_struct_finite", "x_broken = 0"), ("inactive_rows_zero", "true"), ("n_nodes", f"nodes = {UNIVERSE}"), ("node_map_contiguous", "contiguous"), ("weight_log1p_ok", "weights = 0"), ("no_self_loops", "loops = 0"), ("relations_known", "relations = 0"), ("ends_in_universe", "ends = 0"), ("edge_keys_unique", "repeated = 0"), ("has_events", "events > 0")])
)
def graph_gates(spark, d):
    e = vectors.edges_once(spark, d)
    return validate.graph_gates(graph.structural_features(e, tweets(spark, d)), e, events(spark, d), nodes(spark, d), UNIVERSE)


@query(
    f"WITH r AS (SELECT *, lower({_T('record_status')}) AS s FROM normalized_records), k AS (SELECT * FROM r WHERE s = 'retained'), "
    rf"one AS (SELECT (SELECT count(*) FROM r) AS rows, (SELECT count(*) FROM k) AS retained, (SELECT count(*) FROM r WHERE s IN ('retained', 'excluded', 'rejected')) AS named, (SELECT count(*) FROM k WHERE NOT coalesce(regexp_full_match(tweet_id, '\d{{15,20}}'), false)) AS ids, (SELECT count(*) FROM k WHERE node_index IS NULL) AS nodes, "
    f"(SELECT count(*) FROM k WHERE node_index NOT BETWEEN 0 AND {_TOP}) AS range, (SELECT count(*) FROM k WHERE NOT coalesce(snapshot_id BETWEEN 0 AND {_LAST}, false)) AS snapshots, (SELECT count(*) FROM k WHERE created_at_utc IS NULL) AS times, (SELECT count(*) FROM k WHERE exclusion_reason IS NOT NULL) AS reasons, "
    "(SELECT count(*) FROM r WHERE s IN ('excluded', 'rejected') AND exclusion_reason IS NULL) AS unexplained, (SELECT count(*) FROM (SELECT 1 FROM r GROUP BY source_file, source_row_number HAVING count(*) > 1)) AS repeated) "
    + _GATES([("tweet_ids_exact", "ids = 0"), ("retained_all_have_node_index", "nodes = 0"), ("node_index_in_range", "range = 0"), ("retained_snapshot_in_range", "snapshots = 0"), ("retained_all_have_time", "times = 0"), ("retained_have_no_reason", "reasons = 0"), ("others_have_a_reason", "unexplained = 0"), ("statuses_known", "rows = named"), ("row_accounting_balances", "rows = named"), ("locations_unique", "repeated = 0"), ("has_retained", "retained > 0")])
)
def record_gates(spark, d):
    r = table(spark, d, "normalized_records")
    return validate.record_gates(r, r.count(), UNIVERSE)


# -- units -------------------------------------------------------------------------------------------

_BATCHES = (
    _NODE_UNITS + ", pl AS (SELECT unit_hash, sha256(text_normalized) AS content_hash, (row_number() OVER (ORDER BY unit_hash) - 1) // 512 AS b FROM nu WHERE reason IS NULL AND tweet_id IS NOT NULL), "
    "ub AS (SELECT format('b{:08d}-o{:012d}', b, b * 512) AS batch_key, b * 512 AS first_row, count(*) AS rows, sha256(string_agg(unit_hash || ',' || content_hash, chr(10) ORDER BY unit_hash)) AS input_hash, b FROM pl GROUP BY b)"
)


def _unit_batches(spark, d):
    u = selection.node_units(table(spark, d, "normalized_records"), table(spark, d, "duplicate_report"))
    return selection.unit_batches(u.where("reason is null and tweet_id is not null"), 512)


@query(_BATCHES + " SELECT batch_key, first_row, rows, input_hash FROM ub")
def unit_batches(spark, d):
    return _unit_batches(spark, d)


@query(_BATCHES + " SELECT batch_key, CASE WHEN b % 3 = 0 THEN 'new' WHEN b % 3 = 1 THEN 'committed' ELSE 'conflict' END AS outcome FROM ub")
def replay_outcomes(spark, d):
    """The batches run again after some were committed as they are and some with other content."""
    b = _unit_batches(spark, d)
    n = F.col("first_row") / 512 % 3
    before = b.where(n > 0).withColumn("input_hash", F.when(n == 1, F.col("input_hash")).otherwise(F.lit("other")))
    return selection.replay_outcome(b, before)


@query("WITH h AS (SELECT DISTINCT lang, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY content_hash) AS i FROM h) SELECT lang, content_hash FROM r WHERE i <= 32")
def example_hashes(spark, d):
    """Thirty-two examples of the texts of each label, by their hashes: a top-k report."""
    return selection.examples(table(spark, d, "documents"), ["lang"], "text")


@query(
    f"{_NODE_UNITS}, {EDGES} SELECT (SELECT count(*) FROM nu WHERE reason IS NULL) AS units, count(*) AS edges, (SELECT count(*) FROM nu WHERE reason IS NULL) * 256 AS unit_bytes, CAST({DEFAULT.snapshots} AS BIGINT) * {UNIVERSE} * 256 AS node_tensor_bytes, count(*) * 256 AS edge_tensor_bytes, (SELECT count(*) FROM nu WHERE reason IS NULL) / 20.0 AS seconds FROM e"
)
def scale_estimate(spark, d):
    """What vectors of 64 numbers would need for all units, nodes and edges, and the time at twenty units a second."""
    u = selection.node_units(table(spark, d, "normalized_records"), table(spark, d, "duplicate_report")).where("reason is null")
    return selection.scale_estimate(u, edges_of(spark, d), DEFAULT.snapshots, UNIVERSE, 64, 20.0)


_MARK60 = lambda parts: f"CAST('0x' || substr(sha256({parts}), 1, 15) AS BIGINT)"


@query(
    f"WITH {EDGES}, c AS (SELECT snapshot_id, relation_id, src_index, dst_index, t, CAST({_MARK60("snapshot_id || ',' || relation_id || ',' || src_index || ',' || dst_index || ',' || t || ',7'")} % {UNIVERSE} AS INTEGER) AS neg FROM e, range(1, 17) r(t)), "
    "f AS (SELECT c.snapshot_id, c.relation_id, c.src_index, c.dst_index, c.neg, min(t) AS t FROM c ANTI JOIN e o ON o.snapshot_id = c.snapshot_id AND o.relation_id = c.relation_id AND o.src_index = c.src_index AND o.dst_index = c.neg WHERE c.neg <> c.src_index GROUP BY ALL), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, relation_id, src_index, dst_index ORDER BY t, neg) AS i FROM f) SELECT snapshot_id, relation_id, src_index, dst_index, neg AS negative FROM n WHERE i <= 3"
)
def negative_edges(spark, d):
    return selection.negatives(edges_of(spark, d), UNIVERSE)


_VECTOR = "(SELECT {keys}, CAST(j AS INTEGER) AS pos, CAST('0x' || substr(sha256(content_hash || chr(31) || '0'), 8 * j + 1, 8) AS BIGINT) / 2147483647.5 - 1 AS x FROM {source}, range(8) t(j))"
_MOCK = f"WITH {_EVENT_UNITS}, cu AS (SELECT *, sha256(cleaned_text) AS content_hash FROM eu WHERE reason IS NULL), mv AS {_VECTOR.format(keys='DISTINCT content_hash', source='cu')}, mn AS (SELECT content_hash, sqrt(sum(x * x)) AS n FROM mv GROUP BY 1), vv AS (SELECT mv.content_hash, pos, CAST(CAST(x / n AS FLOAT) AS DOUBLE) AS x FROM mv JOIN mn USING (content_hash))"


@query(_MOCK + " SELECT signature, pos, round(x, 6) + 0.0 AS x FROM cu JOIN vv USING (content_hash)")
def mock_encode(spark, d):
    u = core.event_units(spark, d).where("reason is null").select("signature", "content_hash")
    return vectors.flat(pooling.mock_encode(u, 8), ["signature"], "embedding")


@query(
    _MOCK + f", {EDGES}, pe AS (SELECT snapshot_id, relation_id, source_idx AS src_index, target_idx AS dst_index, pos, avg(x) AS x, count(*) AS n FROM cu JOIN vv USING (content_hash) WHERE source_idx <> target_idx AND snapshot_id IS NOT NULL GROUP BY ALL) "
    "SELECT e.snapshot_id, e.relation_id, e.src_index, e.dst_index, coalesce(n, 0) AS valid_count, n IS NOT NULL AS available, CAST(j AS INTEGER) AS pos, round(coalesce(x, 0), 6) + 0.0 AS x FROM e CROSS JOIN range(8) t(j) LEFT JOIN pe ON pe.snapshot_id = e.snapshot_id AND pe.relation_id = e.relation_id AND pe.src_index = e.src_index AND pe.dst_index = e.dst_index AND pe.pos = j"
)
def edge_text_aligned(spark, d):
    """Canonical edges with the mean of their events' mock vectors."""
    u = core.event_units(spark, d).where("reason is null and source_idx <> target_idx and snapshot_id is not null")
    coded = pooling.mock_encode(u.withColumnsRenamed({"source_idx": "src_index", "target_idx": "dst_index"}), 8)
    pooled = pooling.mean_pool(coded, graph.EDGE)
    return vectors.flat(pooling.edge_vectors(edges_of(spark, d), pooled, 8), [*graph.EDGE, "valid_count", "available"])


# -- duplicates, labels, roles -----------------------------------------------------------------------


@query(
    _GROUPS + f"SELECT n.source_file, snapshot_id, count(*) AS rows, count(g.key) AS repeated_rows, count(*) FILTER (g.key IS NOT NULL AND NOT (g.first.f = n.source_file AND g.first.r = n.source_row_number)) AS dropped_rows "
    f"FROM normalized_records n LEFT JOIN (FROM g WHERE occurrences > 1) g ON g.key = {_T('n.tweet_id')} GROUP BY ALL"
)
def dup_effects(spark, d):
    return records.duplicate_effects(table(spark, d, "normalized_records"))


@query(
    f"WITH a AS (SELECT sha256(text_normalized) AS h, author_account_id AS w, count(*) AS n, min(created_at_utc) AS a, max(created_at_utc) AS b FROM normalized_records WHERE NOT {_BLANK('text_normalized')} GROUP BY ALL), "
    "p AS (SELECT h, sum(n) AS n, count(w) AS authors, coalesce(bool_or(a < b), false) AS times FROM a GROUP BY 1 HAVING sum(n) > 1) "
    "SELECT CASE WHEN authors > 1 THEN 'several_authors' WHEN authors = 0 THEN 'no_author' WHEN times THEN 'same_author_other_time' ELSE 'same_author_same_time' END AS scope, count(*) AS texts, CAST(sum(n) AS BIGINT) AS rows FROM p GROUP BY 1"
)
def repeats_by_scope(spark, d):
    return records.repeats_by_scope(table(spark, d, "normalized_records"))


@query(
    f"WITH {EDGES}, s AS (SELECT DISTINCT snapshot_id, src_index AS node_index FROM e UNION SELECT DISTINCT snapshot_id, dst_index FROM e), "
    f"g AS (SELECT * FROM s UNION SELECT DISTINCT snapshot_id, node_index FROM normalized_records WHERE lower({_T('record_status')}) = 'retained' AND NOT {_BLANK('text_normalized')} AND snapshot_id IS NOT NULL AND node_index IS NOT NULL), "
    "b AS (SELECT g.*, s.node_index IS NOT NULL AS l FROM g LEFT JOIN s ON s.snapshot_id = g.snapshot_id AND s.node_index = g.node_index) "
    "SELECT b.snapshot_id, count(*) AS eligible, count(*) FILTER (b.l) AS labelled, round(count(*) FILTER (b.l) / count(*), 6) AS share, count(*) FILTER (b.l AND coalesce(p.l, false)) AS pairs FROM b LEFT JOIN b p ON p.snapshot_id = b.snapshot_id - 1 AND p.node_index = b.node_index GROUP BY 1"
)
def label_coverage(spark, d):
    """Nodes with structure or text, and those of them that a partition of the graph labels."""
    e = vectors.edges_once(spark, d)
    struct = e.select("snapshot_id", F.explode(F.array("src_index", "dst_index")).alias("node_index"))
    text = core.plain_records(spark, d).where((F.col("record_status") == "retained") & ~diagnostics.is_blank(F.col("text_normalized"))).select("snapshot_id", "node_index")
    return diagnostics.label_coverage(struct.unionByName(text), struct)


@query(
    "WITH c AS (SELECT DISTINCT column_name, lower(trim(column_name)) AS c FROM schema_registry) "
    + " UNION ALL ".join(f"SELECT column_name, '{role}' AS role FROM c WHERE " + " OR ".join(f"regexp_matches(c, '{p}')" for p in patterns) for role, patterns in profile.ROLES.items())
)
def column_roles(spark, d):
    return profile.role_table(table(spark, d, "schema_registry").select("column_name").distinct(), "column_name")


# -- partitions over time ----------------------------------------------------------------------------

#: The metrics before they are rounded, and a partition that changes from quarter to quarter.
_MODULARITY = vectors.SQL["modularity_directed"].replace("round(i / t - coalesce(s, 0) / (t * t), 6)", "i / t - coalesce(s, 0) / (t * t)")
_FUTURE = vectors.SQL["future_link_ap"].replace("round(sum(hits * tp / seen) / sum(hits), 6)", "sum(hits * tp / seen) / sum(hits)")
_CONDUCTANCE = vectors.SQL["conductance"].replace("round(CASE WHEN", "(CASE WHEN").replace("ELSE 0 END, 6)", "ELSE 0 END)")
_MOVING = lambda node, snap: f"(({node} + 3 * ({snap} // 4)) % 7)"


def _moving(spark, d):
    n = vectors.partition(edges_of(spark, d))
    return n.withColumn("community", (F.col("node_index") + 3 * F.floor(F.col("snapshot_id") / 4)) % 7)


@query("WITH m AS (" + _MODULARITY + "), p AS (SELECT snapshot_id, avg(modularity) AS modularity, count(*) AS relations FROM m GROUP BY 1) SELECT snapshot_id, round(modularity, 5) AS modularity, relations FROM p UNION ALL SELECT NULL, round(avg(modularity), 5), CAST(sum(relations) AS BIGINT) FROM p")
def modularity_macro(spark, d):
    """Mean modularity over the relations of each snapshot, and over all snapshots (snapshot_id NULL)."""
    e = vectors.edges_once(spark, d)
    return model.macro_means(model.directed_modularity(e, vectors.partition(e)), "modularity").withColumn("modularity", F.round("modularity", 5))


@query("WITH m AS (" + _FUTURE + "), p AS (SELECT snapshot_id, avg(average_precision) AS average_precision, count(*) AS relations FROM m GROUP BY 1) SELECT snapshot_id, round(average_precision, 5) AS average_precision, relations FROM p UNION ALL SELECT NULL, round(avg(average_precision), 5), CAST(sum(relations) AS BIGINT) FROM p")
def future_link_macro(spark, d):
    e = vectors.edges_once(spark, d)
    return model.macro_means(model.future_links(e, vectors.partition(e)), "average_precision").withColumn("average_precision", F.round("average_precision", 5))


@query("WITH c AS (" + _CONDUCTANCE + ") SELECT snapshot_id, count(*) AS communities, round(sum(conductance * volume) / sum(volume), 5) AS weighted, round(quantile_cont(conductance, 0.5), 5) AS median, round(quantile_cont(conductance, 0.9), 5) AS p90 FROM c GROUP BY 1")
def conductance_summary(spark, d):
    e = vectors.edges_once(spark, d)
    s = model.conductance_summary(model.conductance(e, vectors.partition(e)))
    return s.select("snapshot_id", "communities", *[F.round(c, 5).alias(c) for c in ("weighted", "median", "p90")])


_AGREE = """, r AS (SELECT {k}, u, CAST(sum(n) AS DOUBLE) AS a FROM c GROUP BY ALL), w AS (SELECT {k}, v, CAST(sum(n) AS DOUBLE) AS b FROM c GROUP BY ALL), t AS (SELECT {k}, CAST(sum(n) AS DOUBLE) AS n FROM c GROUP BY ALL),
mi AS (SELECT {k}, sum(c.n / t.n * ln(c.n * t.n / (a * b))) AS mi, sum(c.n * (c.n - 1) / 2) AS pairs FROM c JOIN r USING ({k}, u) JOIN w USING ({k}, v) JOIN t USING ({k}) GROUP BY ALL),
hu AS (SELECT {k}, -sum(a / n * ln(a / n)) AS hu, sum(a * (a - 1) / 2) AS pa FROM r JOIN t USING ({k}) GROUP BY ALL), hv AS (SELECT {k}, -sum(b / n * ln(b / n)) AS hv, sum(b * (b - 1) / 2) AS pb FROM w JOIN t USING ({k}) GROUP BY ALL),
ce AS (SELECT {k}, a, b, n, unnest(range(CAST(greatest(1, a + b - n) AS BIGINT), CAST(least(a, b) AS BIGINT) + 1)) AS i FROM r JOIN w USING ({k}) JOIN t USING ({k})),
em AS (SELECT {k}, sum(i / n * ln(n * i / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(n - a + 1) + lgamma(n - b + 1) - lgamma(n + 1) - lgamma(i + 1) - lgamma(a - i + 1) - lgamma(b - i + 1) - lgamma(n - a - b + i + 1))) AS e FROM ce GROUP BY ALL),
ag AS (SELECT {k}, t.n, mi, CASE WHEN abs((hu + hv) / 2 - e) > 1e-15 THEN (mi - e) / ((hu + hv) / 2 - e) ELSE 1 END AS ami, coalesce((pairs - pa * pb / nullif(t.n * (t.n - 1) / 2, 0)) / nullif((pa + pb) / 2 - pa * pb / nullif(t.n * (t.n - 1) / 2, 0), 0), 1) AS ari
  FROM t JOIN mi USING ({k}) JOIN hu USING ({k}) JOIN hv USING ({k}) JOIN em USING ({k}))"""


@query(
    f"WITH {EDGES}, p AS (SELECT DISTINCT snapshot_id, node_index, {_MOVING('node_index', 'snapshot_id')} AS x FROM (SELECT snapshot_id, src_index AS node_index FROM e UNION SELECT snapshot_id, dst_index FROM e)), "
    "c AS (SELECT a.snapshot_id, a.x AS u, b.x AS v, count(*) AS n FROM p a JOIN p b ON b.snapshot_id = a.snapshot_id + 1 AND b.node_index = a.node_index GROUP BY ALL)" + _AGREE.format(k="snapshot_id") + " SELECT snapshot_id, n, round(ami, 5) AS ami, round(ari, 5) AS ari FROM ag"
)
def consecutive_agreement(spark, d):
    """How far each quarter's partition of the active nodes agrees with the next one's."""
    a = model.consecutive_agreement(written(_moving(spark, d), "partition"))
    return a.select("snapshot_id", "n", F.round("ami", 5).alias("ami"), F.round("ari", 5).alias("ari"))


@query(
    "WITH p AS (SELECT CAST(r AS INTEGER) AS run, node_index, (node_index // (r + 1)) % 5 AS x FROM node_universe, range(4) t(r)), c AS (SELECT a.run AS ra, b.run AS rb, a.x AS u, b.x AS v, count(*) AS n FROM p a JOIN p b ON b.node_index = a.node_index AND a.run < b.run GROUP BY ALL)"
    + _AGREE.format(k="ra, rb") + " SELECT count(*) AS pairs, round(avg(ami), 6) AS ami, round(avg(ari), 6) AS ari FROM ag"
)
def seed_stability(spark, d):
    """Mean agreement of four partitions of all nodes with each other."""
    n = nodes(spark, d).select("node_index", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("run"))
    s = model.stability(n.withColumn("community", F.floor(F.col("node_index") / (F.col("run") + 1)) % 5))
    return s.select("pairs", F.round("ami", 6).alias("ami"), F.round("ari", 6).alias("ari"))


@query(
    f"WITH {vectors.U}, q AS (SELECT vec_id FROM u WHERE vec_id % 50 = 0), nn AS (SELECT vec_id, sqrt(sum(x * x)) AS a, sqrt(sum(CASE WHEN pos < 16 THEN x * x END)) AS b FROM f GROUP BY 1), "
    "s AS (SELECT x.vec_id AS q, y.vec_id AS o, sum(x.x * y.x) AS d, sum(CASE WHEN x.pos < 16 THEN x.x * y.x END) AS h FROM f x JOIN q ON q.vec_id = x.vec_id JOIN f y ON y.pos = x.pos AND y.vec_id <> x.vec_id GROUP BY ALL), "
    "r AS (SELECT q, o, row_number() OVER (PARTITION BY q ORDER BY round(d / (m.a * n.a), 9) DESC, o) AS i, row_number() OVER (PARTITION BY q ORDER BY round(h / (m.b * n.b), 9) DESC, o) AS j FROM s JOIN nn m ON m.vec_id = q JOIN nn n ON n.vec_id = o) "
    "SELECT q AS vec_id, count(*) FILTER (i <= 10 AND j <= 10) / 10.0 AS overlap FROM r GROUP BY 1"
)
def neighbour_overlap(spark, d):
    """Share of a vector's ten nearest that stay its nearest when vectors are cut to sixteen numbers; queries are the ids divisible by fifty, against all."""
    u = vectors.units(spark, d).select("vec_id", "embedding")
    return model.neighbour_overlap(u.where("vec_id % 50 = 0"), u, "vec_id", "embedding", 16, 10)


@query()
def kmeans_clusters(spark, d):
    """The embeddings in ten clusters by k-means with three starts: members and mean distance of each."""
    u = vectors.units(spark, d).select("vec_id", "embedding")
    best = model.kmeans(u, "vec_id", "embedding", 10, restarts=3)
    near = model._nearest(u.where("embedding is not null"), "vec_id", "embedding", best["centres"])
    return near.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.round(F.avg("d"), 6).alias("mean_square_distance"))


_WEIGHTS = {"structural_bce": 1.0, "cluster_kl": 0.1, "semantic_loss": 0.5, "proto_separation": 0.05}


@query(
    "WITH p AS (SELECT " + ", ".join(f"({vectors.SQL[n]}) AS {n}" for n in _WEIGHTS) + ") SELECT *, round(" + " + ".join(f"{w} * {n}" for n, w in _WEIGHTS.items()) + ", 5) AS total FROM p"
)
def weighted_loss(spark, d):
    """The losses of structure, clusters, meaning and prototypes, and their weighted sum."""
    parts = {n: (w, vectors.QUERIES[n](spark, d)) for n, w in _WEIGHTS.items()}
    return model.weighted_loss(parts).withColumn("total", F.round("total", 5))
