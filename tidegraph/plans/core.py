"""Queries of the graph, record, diagnostics and selection operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegraph.config import DEFAULT, FEATURES, RELATIONS
from tidegraph.functions import hashing, times
from tidegraph.functions.ids import account_id, tweet_id, tweet_id_error
from tidegraph.functions.text import normalized_text, plain_status
from tidegraph.operators import diagnostics, drift, graph, profile, records, selection, validate
from tidegraph.operators.skew import account_key
from tidegraph.plans.dealt import CELLS, INSTANTS
from tidegraph.sources.tables import table

QUERIES = {}
SQL = {}
FIRST = DEFAULT.first_index
LAST = DEFAULT.snapshots - 1


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# -- inputs ------------------------------------------------------------------------------------------


def interactions(spark, d):
    return graph.event_interactions(table(spark, d, "graph_events"), table(spark, d, "calendar_sources"))


def nodes(spark, d):
    return table(spark, d, "node_universe").select("account_id", "node_index")


def events(spark, d):
    return graph.relation_events(interactions(spark, d), nodes(spark, d))


def edges_of(spark, d):
    return graph.edges(events(spark, d))


def tweets(spark, d):
    return graph.authored_counts(interactions(spark, d), nodes(spark, d))


def plain_records(spark, d):
    """Records with their status in its plain spelling."""
    r = table(spark, d, "normalized_records")
    return r.withColumn("record_status", plain_status(F.col("record_status")))


_WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1c-\x1f]"
_T = lambda c: f"nullif(regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g'), '')"
_BLANK = lambda c: f"({c} IS NULL OR regexp_full_match({c}, '{_WS}*'))"
_SNAP = lambda c: f"CASE WHEN year({c}) * 4 + quarter({c}) - 1 - {FIRST} BETWEEN 0 AND {LAST} THEN year({c}) * 4 + quarter({c}) - 1 - {FIRST} END"
INTERACTIONS = rf"""{INSTANTS},
i AS (SELECT e.source_file, source_row_number, {_T('author_account_id')} AS a, {_T('target_account_id')} AS t, relation_id, signature, nfc_normalize(regexp_replace(replace(cleaned_text, chr(65279), ''), '\r\n?', chr(10), 'g')) AS cleaned_text,
  instant AS created FROM graph_events e JOIN ts_o USING (event_id)),
x AS (SELECT i.*, s.node_index AS source_idx, g.node_index AS target_idx, {_SNAP('created')} AS snapshot_id FROM i LEFT JOIN node_universe s ON s.account_id = i.a LEFT JOIN node_universe g ON g.account_id = i.t),
l AS (SELECT *, CASE WHEN a IS NULL THEN 'missing_author' WHEN source_idx IS NULL THEN 'author_outside_universe' WHEN created IS NULL THEN 'invalid_timestamp' WHEN snapshot_id IS NULL THEN 'outside_calendar'
  WHEN t IS NULL THEN 'no_relation_target' WHEN relation_id IS NULL OR relation_id NOT BETWEEN 0 AND 3 THEN 'invalid_relation' WHEN t = a THEN 'self_loop' WHEN target_idx IS NULL THEN 'external_target' ELSE 'event' END AS reason FROM x)"""
EVENTS = INTERACTIONS + f""",
ev AS (SELECT signature, CAST(snapshot_id AS INTEGER) AS snapshot_id, relation_id, source_idx, target_idx, cleaned_text, substr(sha256(CASE WHEN {_BLANK('cleaned_text')} THEN '' ELSE cleaned_text END), 1, 16) AS text_hash,
  CASE WHEN coalesce(cleaned_text, '') = '' THEN 'empty' WHEN {_BLANK('cleaned_text')} THEN 'whitespace_only' ELSE 'ok' END AS text_quality, source_file, source_row_number
  FROM (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY source_file, source_row_number) AS rn FROM l WHERE reason = 'event') WHERE rn = 1)"""
EDGES = EVENTS + """,
e AS (SELECT snapshot_id, relation_id, source_idx AS src_index, target_idx AS dst_index, count(DISTINCT signature) AS count_raw, ln(1 + count(DISTINCT signature)) AS weight_log1p FROM ev WHERE source_idx <> target_idx GROUP BY ALL)"""
TWEETS = """,
tw AS (SELECT CAST(snapshot_id AS INTEGER) AS snapshot_id, source_idx AS node_index, count(*) AS tweet_count FROM (SELECT DISTINCT source_file, source_row_number, snapshot_id, source_idx FROM x WHERE source_idx IS NOT NULL AND snapshot_id IS NOT NULL) GROUP BY ALL)"""
RECORDS = f"r AS (SELECT * REPLACE (lower({_T('record_status')}) AS record_status) FROM normalized_records)"
_DEGREES = """,
dg AS (SELECT snapshot_id, relation_id, node_index, count(*) FILTER (o) AS out_degree, count(*) FILTER (NOT o) AS in_degree, CAST(coalesce(sum(count_raw) FILTER (o), 0) AS BIGINT) AS out_strength, CAST(coalesce(sum(count_raw) FILTER (NOT o), 0) AS BIGINT) AS in_strength
  FROM (SELECT snapshot_id, relation_id, src_index AS node_index, true AS o, count_raw FROM e UNION ALL SELECT snapshot_id, relation_id, dst_index, false, count_raw FROM e) GROUP BY ALL)"""
_X = """,
xs AS (SELECT coalesce(d.snapshot_id, tw.snapshot_id) AS snapshot_id, coalesce(d.node_index, tw.node_index) AS node_index, """ + ", ".join(f"round(coalesce({r}_{f}, 0), 6) AS {r}_{f}" for r in RELATIONS for f in ("out_degree", "in_degree", "out_strength_log1p", "in_strength_log1p")) + """,
  round(coalesce(ln(1 + tweet_count), 0), 6) AS tweet_count_log1p FROM (SELECT snapshot_id, node_index, """ + ", ".join(
    f"CAST(max(CASE WHEN relation_id = {i} THEN {v} END) AS DOUBLE) AS {r}_{f}" for i, r in enumerate(RELATIONS) for f, v in (("out_degree", "out_degree"), ("in_degree", "in_degree"), ("out_strength_log1p", "ln(1 + out_strength)"), ("in_strength_log1p", "ln(1 + in_strength)"))
) + " FROM dg GROUP BY ALL) d FULL JOIN tw ON d.snapshot_id = tw.snapshot_id AND d.node_index = tw.node_index)"
_CAL = f"SELECT CAST(i AS INTEGER) AS snapshot_id, year(s) || '-Q' || quarter(s) AS label, CAST(s AS DATE) AS start, CAST(s + INTERVAL 3 MONTH AS DATE) AS \"end\" FROM (SELECT i, DATE '2017-10-01' + to_months(CAST(3 * i AS INTEGER)) AS s FROM range({LAST + 1}) t(i))"

# -- time and calendar -------------------------------------------------------------------------------


@query(_CAL)
def calendar_bins(spark, d):
    return times.calendar(spark)


@query(f"WITH {INTERACTIONS} SELECT source_file, source_row_number, CAST(snapshot_id AS INTEGER) AS snapshot_id FROM x WHERE created IS NOT NULL")
def snapshot_assign(spark, d):
    return interactions(spark, d).where("created is not null").select("source_file", "source_row_number", times.snapshot(F.col("created")).alias("snapshot_id"))


_REASON = f"""WITH v AS (SELECT {_T('created_at_original')} AS s FROM normalized_records),
e AS (SELECT s, CASE WHEN regexp_full_match(s, '[+-]?\\d+(\\.\\d+)?([eE][+-]?\\d+)?') THEN CAST(trunc(CASE WHEN abs(CAST(s AS DOUBLE)) > 1e12 THEN CAST(s AS DOUBLE) / 1000 ELSE CAST(s AS DOUBLE) END) AS BIGINT) END AS n FROM v),
t AS (SELECT s, n, CASE WHEN n BETWEEN epoch(TIMESTAMP '2006-03-21') AND epoch(TIMESTAMP '2026-06-30 23:59:59') THEN make_timestamp(n * 1000000) END AS t FROM e),
q AS (SELECT *, year(t) * 4 + quarter(t) - 1 - {FIRST} AS k FROM t)
SELECT CASE WHEN s IS NULL THEN 'MISSING' WHEN regexp_full_match(lower(s), '[+-]?(nan|inf|infinity)') THEN 'CORRUPT' WHEN n IS NULL THEN 'UNPARSABLE' WHEN t IS NULL THEN 'EPOCH_OUTLIER'
  WHEN k < 0 THEN 'OUT_OF_RANGE_BEFORE' WHEN k > {LAST} THEN 'OUT_OF_RANGE_AFTER' ELSE 'IN_RANGE' END AS reason, count(*) AS rows FROM q GROUP BY 1"""


@query(_REASON)
def ts_reason_counts(spark, d):
    return diagnostics.reason_counts(table(spark, d, "normalized_records"), times.time_reason(F.col("created_at_original")))


_REPORT = f""", cal AS ({_CAL}),
rp AS (SELECT cal.snapshot_id, label, coalesce(n, 0) AS rows, coalesce(nodes, 0) AS nodes, first_epoch, last_epoch FROM cal LEFT JOIN (
  SELECT snapshot_id, count(*) AS n, count(DISTINCT source_idx) AS nodes, CAST(floor(min(epoch(created))) AS BIGINT) AS first_epoch, CAST(floor(max(epoch(created))) AS BIGINT) AS last_epoch FROM x WHERE snapshot_id IS NOT NULL GROUP BY 1) g ON g.snapshot_id = cal.snapshot_id)"""


@query(f"WITH {INTERACTIONS}{_REPORT} SELECT * FROM rp")
def calendar_report(spark, d):
    rows = graph.indexed(interactions(spark, d), nodes(spark, d)).select("snapshot_id", F.col("source_idx").alias("node_index"), "created")
    return diagnostics.calendar_report(rows, times.calendar(spark))


@query(
    f"WITH {INTERACTIONS}{_REPORT}, b AS (SELECT min(snapshot_id) FILTER (rows > 0) AS lo, max(snapshot_id) FILTER (rows > 0) AS hi FROM rp) "
    "SELECT snapshot_id, label, CASE WHEN lo IS NULL OR snapshot_id < lo THEN 'leading' WHEN snapshot_id > hi THEN 'trailing' ELSE 'internal' END AS position FROM rp, b WHERE rows = 0"
)
def empty_quarters(spark, d):
    """The quarters of the calendar without any event."""
    return diagnostics.empty_quarters(calendar_report(spark, d))


# -- identity ----------------------------------------------------------------------------------------


@query(
    f"WITH a AS (SELECT {_T('author_account_id')} AS id FROM graph_events UNION SELECT {_T('target_account_id')} FROM graph_events UNION SELECT {_T('author_account_id')} FROM normalized_records) "
    "SELECT id AS account_id, CAST(row_number() OVER (ORDER BY CAST(id AS HUGEINT)) - 1 AS INTEGER) AS node_index FROM a WHERE regexp_full_match(id, '\\d+')"
)
def node_map(spark, d):
    e = table(spark, d, "graph_events")
    ids = e.select(F.explode(F.array("author_account_id", "target_account_id")).alias("account_id")).union(table(spark, d, "normalized_records").select("author_account_id"))
    return graph.node_map(ids)


@query(
    "SELECT count(*) AS nodes, count(DISTINCT account_id) AS accounts, count(DISTINCT node_index) AS indices, min(node_index) AS lowest, max(node_index) AS highest, "
    "count(DISTINCT node_index) = count(*) AND min(node_index) = 0 AND max(node_index) = count(*) - 1 AS contiguous FROM node_universe"
)
def node_map_gate(spark, d):
    return validate.node_map_gate(nodes(spark, d))


_RECON = f"WITH {RECORDS}, g AS (SELECT {_T('author_account_id')} AS account_id, count(*) AS rows, count(*) FILTER (record_status = 'retained') AS retained FROM r WHERE {_T('author_account_id')} IS NOT NULL GROUP BY 1) "


@query(_RECON + "SELECT g.account_id, rows, retained, node_index, node_index IS NOT NULL AS matched FROM g LEFT JOIN node_universe n ON n.account_id = g.account_id")
def account_reconciliation(spark, d):
    return records.account_reconciliation(table(spark, d, "normalized_records"), nodes(spark, d))


@query(_RECON + "SELECT g.account_id, rows FROM g ANTI JOIN node_universe n ON n.account_id = g.account_id")
def unmatched_accounts(spark, d):
    return records.account_reconciliation(table(spark, d, "normalized_records"), nodes(spark, d)).where("not matched").select("account_id", "rows")


@query(
    f"WITH a AS (SELECT DISTINCT {_T('author_account_id')} AS id FROM graph_events), b AS (SELECT DISTINCT {_T('author_account_id')} AS id FROM normalized_records), n AS (SELECT DISTINCT account_id AS id FROM node_universe), "
    "u AS (SELECT id FROM (SELECT id FROM a UNION SELECT id FROM b UNION SELECT id FROM n) WHERE id IS NOT NULL), f AS (SELECT id IN (FROM a) AS a, id IN (FROM b) AS b, id IN (FROM n) AS n FROM u) "
    "SELECT count(*) FILTER (a AND b) AS in_both, count(*) FILTER (a AND NOT b) AS only_events, count(*) FILTER (b AND NOT a) AS only_records, count(*) FILTER ((a OR b) AND NOT n) AS outside_universe, count(*) FILTER (n AND NOT a AND NOT b) AS unseen FROM f"
)
def author_overlap(spark, d):
    return records.author_overlap(table(spark, d, "graph_events"), table(spark, d, "normalized_records"), nodes(spark, d))


@query(
    rf"WITH v AS (SELECT record_id, coalesce({_T('tweet_id')}, '') AS s FROM normalized_records) SELECT CASE WHEN regexp_full_match(s, '[+-]?\d+(\.\d*)?([eE][+-]?\d+)?') AND regexp_matches(s, '[.eE]') THEN 'invalid_tweet_id_float' "
    r"WHEN NOT regexp_full_match(s, '\d{15,20}') THEN 'invalid_tweet_id' ELSE 'ok' END AS outcome, count(*) AS rows FROM v GROUP BY 1"
)
def tweet_id_check(spark, d):
    return table(spark, d, "normalized_records").groupBy(F.coalesce(tweet_id_error(F.col("tweet_id")), F.lit("ok")).alias("outcome")).agg(F.count(F.lit(1)).alias("rows"))


# -- events and graph --------------------------------------------------------------------------------


@query(f"WITH {INTERACTIONS} SELECT reason, count(*) AS rows FROM l GROUP BY reason")
def event_ladder_counts(spark, d):
    return graph.ladder_counts(interactions(spark, d), nodes(spark, d))


@query(f"WITH {EVENTS} SELECT * FROM ev")
def relation_events(spark, d):
    return events(spark, d)


@query(
    f"WITH {INTERACTIONS} SELECT source_file, source_row_number, sha256(a || chr(31) || strftime(created, '%Y-%m-%dT%H:%M:%S') || '+00:00' || chr(31) || substr(sha256(CASE WHEN {_BLANK('cleaned_text')} THEN '' ELSE cleaned_text END), 1, 16) || chr(31) || relation_id || chr(31) || t || chr(31)) AS signature FROM l WHERE reason = 'event'"
)
def event_signatures(spark, d):
    x = graph.indexed(interactions(spark, d), nodes(spark, d)).where(graph.ladder() == "event")
    return x.select("source_file", "source_row_number", graph.signature().alias("signature"))


@query(f"WITH {EDGES} SELECT snapshot_id, relation_id, src_index, dst_index, count_raw, round(weight_log1p, 6) AS weight_log1p FROM e")
def edges(spark, d):
    return edges_of(spark, d).withColumn("weight_log1p", F.round("weight_log1p", 6))


@query(f"WITH {EDGES} SELECT snapshot_id, relation_id, count(*) AS edges, CAST(sum(count_raw) AS BIGINT) AS events FROM e GROUP BY ALL")
def edge_partition_counts(spark, d):
    return edges_of(spark, d).groupBy("snapshot_id", "relation_id").agg(F.count(F.lit(1)).alias("edges"), F.sum("count_raw").alias("events"))


@query(f"WITH {INTERACTIONS}{TWEETS} SELECT * FROM tw")
def authored_counts(spark, d):
    return tweets(spark, d)


@query(f"WITH {EDGES}{_DEGREES} SELECT * FROM dg")
def degree_strength(spark, d):
    return graph.degrees(edges_of(spark, d))


@query(f"WITH {EDGES}{TWEETS}{_DEGREES}{_X} SELECT *, true AS struct_active FROM xs")
def x_struct(spark, d):
    x = graph.structural_features(edges_of(spark, d), tweets(spark, d))
    return x.withColumns({f: F.round(f, 6) for f in FEATURES})


@query(f"WITH {EDGES}{TWEETS}{_DEGREES}{_X} SELECT snapshot_id, count(*) AS active_nodes FROM xs GROUP BY 1")
def struct_mask(spark, d):
    return graph.active_counts(graph.structural_features(edges_of(spark, d), tweets(spark, d)))


@query(f"WITH {EDGES} SELECT snapshot_id, relation_id, dst_index, account_id, count_raw FROM e JOIN node_universe n ON n.node_index = e.dst_index WHERE src_index = 711")
def neighbors_1hop(spark, d):
    return graph.neighbours(edges_of(spark, d), nodes(spark, d), 711)


@query(f"WITH {EDGES} SELECT snapshot_id, node_index, " + ", ".join(f"bool_or(relation_id = {i}) AS {r}" for i, r in enumerate(RELATIONS)) + " FROM (SELECT snapshot_id, relation_id, src_index AS node_index FROM e UNION ALL SELECT snapshot_id, relation_id, dst_index FROM e) GROUP BY ALL")
def relation_availability(spark, d):
    return graph.relation_availability(edges_of(spark, d))


@query(f"WITH {EDGES} SELECT snapshot_id, relation_id, src_index, dst_index, row_number() OVER (ORDER BY snapshot_id, relation_id, src_index, dst_index) - 1 AS edge_idx FROM e")
def edge_ordinals(spark, d):
    return graph.edge_ordinals(edges_of(spark, d)).select(*graph.EDGE, "edge_idx")


@query(f"WITH {EDGES} SELECT src_index AS src, dst_index AS dst, ['mention', 'retweet', 'reply', 'quote'][relation_id + 1] AS relation, snapshot_id, count_raw, round(weight_log1p, 6) AS weight_log1p FROM e")
def property_graph_edges(spark, d):
    return graph.property_graph(edges_of(spark, d), nodes(spark, d))[1].withColumn("weight_log1p", F.round("weight_log1p", 6))


@query(
    f"WITH {EDGES}, p AS (SELECT * FROM e UNION ALL SELECT snapshot_id, relation_id, src_index, src_index, count_raw, weight_log1p FROM e WHERE dst_index % 50 = 0 UNION ALL SELECT snapshot_id, relation_id, src_index, dst_index, count_raw, weight_log1p + 0.1 FROM e WHERE dst_index % 75 = 0) "
    "SELECT 'self_loop' AS problem, count(*) AS edges FROM p WHERE src_index = dst_index UNION ALL SELECT 'wrong_weight', count(*) FROM p WHERE abs(weight_log1p - ln(1 + count_raw)) > 1e-6 "
    "UNION ALL SELECT 'repeated_key', count(*) FROM (SELECT 1 FROM p GROUP BY snapshot_id, relation_id, src_index, dst_index HAVING count(*) > 1)"
)
def edge_gates(spark, d):
    """The gates on edges, some of which are made wrong: self-loops, weights and keys."""
    e = edges_of(spark, d)
    loops = e.where("dst_index % 50 = 0").withColumn("dst_index", F.col("src_index"))
    heavy = e.where("dst_index % 75 = 0").withColumn("weight_log1p", F.col("weight_log1p") + 0.1)
    return validate.edge_gates(e.unionByName(loops).unionByName(heavy))


@query(f"WITH {EDGES} SELECT snapshot_id, relation_id, src_index, dst_index, CAST(1 AS BIGINT) AS count_raw, round(ln(2), 6) AS weight_log1p FROM e")
def edges_binary(spark, d):
    return graph.binary(edges_of(spark, d)).withColumn("weight_log1p", F.round("weight_log1p", 6))


@query(
    f"WITH {EDGES} SELECT snapshot_id, relation_id, src_index, dst_index, CAST(sum(count_raw) AS BIGINT) AS count_raw, round(ln(1 + sum(count_raw)), 6) AS weight_log1p "
    "FROM (SELECT snapshot_id, relation_id, src_index, dst_index, count_raw FROM e UNION ALL SELECT snapshot_id, relation_id, dst_index, src_index, count_raw FROM e) GROUP BY ALL"
)
def edges_symmetrized(spark, d):
    return graph.symmetrized(edges_of(spark, d)).withColumn("weight_log1p", F.round("weight_log1p", 6))


@query(f"WITH {EDGES} SELECT snapshot_id, src_index, dst_index, CAST(sum(count_raw) AS BIGINT) AS count_raw, round(ln(1 + sum(count_raw)), 6) AS weight_log1p FROM e GROUP BY ALL")
def edges_relation_collapsed(spark, d):
    return graph.collapsed(edges_of(spark, d)).withColumn("weight_log1p", F.round("weight_log1p", 6))


@query(f"WITH {EDGES} SELECT snapshot_id, relation_id, src_index, CAST(sum(count_raw) AS DOUBLE) AS raw_sum, round(sum(weight_log1p), 6) AS sum_of_logs, round(ln(1 + sum(count_raw)), 6) AS log_of_sum FROM e GROUP BY ALL")
def strength_variants(spark, d):
    e = edges_of(spark, d).groupBy("snapshot_id", "relation_id", "src_index")
    return e.agg(F.round(F.sum("count_raw").cast("double"), 6).alias("raw_sum"), F.round(F.sum("weight_log1p"), 6).alias("sum_of_logs"), F.round(F.log1p(F.sum("count_raw")), 6).alias("log_of_sum"))


# -- normalisation -----------------------------------------------------------------------------------


def raw_sheet(spark, d):
    """The rows of the raw files as the ten text columns of the contract, where they still have these names."""
    j = lambda c: F.get_json_object("record_json", f"$.{c}").alias(c)
    return table(spark, d, "dataset_b_raw").select(*[j(c) for c in ("id", "created_at", "user", "text", *records.METRICS)], "source_file", "source_sheet", "source_row_number")


def unified_sheet(spark, d):
    """As ``raw_sheet``, with renamed columns followed to the contract's names."""
    columns = ["id", "created_at", "user", "text", *records.METRICS]
    return drift.sheet(table(spark, d, "dataset_b_raw"), table(spark, d, "schema_registry"), columns).select(*columns, "source_file", "source_sheet", "source_row_number")


_SHEET = CELLS + """,
wd AS (SELECT source_file, source_row_number, h, max(CASE WHEN canonical = 'id' AND own THEN x END) AS id, max(CASE WHEN canonical = 'created_at' AND own THEN x END) AS ts, max(CASE WHEN canonical = 'user' AND own THEN x END) AS u, max(CASE WHEN canonical = 'text' AND own THEN x END) AS tx FROM fs GROUP BY ALL),
sh AS (SELECT b.source_file, b.source_row_number, id, ts, u, tx FROM dataset_b_raw b LEFT JOIN wd ON wd.source_file = b.source_file AND wd.source_row_number = b.source_row_number AND wd.h = md5(b.record_json))"""
_NORMAL = rf"""{_SHEET},
n1 AS (SELECT coalesce({_T('id')}, '') AS s, {_T('ts')} AS t, {_T('u')} AS u FROM sh),
n2 AS (SELECT *, CASE WHEN regexp_full_match(s, '[+-]?\d+(\.\d*)?([eE][+-]?\d+)?') AND regexp_matches(s, '[.eE]') THEN 'invalid_tweet_id_float' WHEN NOT regexp_full_match(s, '\d{{15,20}}') THEN 'invalid_tweet_id' END AS bad,
  CASE WHEN regexp_full_match(t, '[+-]?\d+(\.\d+)?([eE][+-]?\d+)?') THEN CAST(trunc(CASE WHEN abs(CAST(t AS DOUBLE)) > 1e12 THEN CAST(t AS DOUBLE) / 1000 ELSE CAST(t AS DOUBLE) END) AS BIGINT) END AS n,
  CASE WHEN u IS NULL OR lower(u) IN ('none', 'null', 'nan') THEN 'missing_user' WHEN regexp_extract(u, '[''"]id[''"]\s*:\s*[''"]?(\d+)', 1) = '' THEN 'malformed_user_blob' END AS wrong, regexp_extract(u, '[''"]id[''"]\s*:\s*[''"]?(\d+)', 1) AS a FROM n1),
n3 AS (SELECT n2.*, node_index, CASE WHEN n BETWEEN epoch(TIMESTAMP '2006-03-21') AND epoch(TIMESTAMP '2026-06-30 23:59:59') THEN make_timestamp(n * 1000000) END AS c FROM n2 LEFT JOIN node_universe g ON g.account_id = n2.a),
n4 AS (SELECT CASE WHEN bad IS NOT NULL THEN bad WHEN wrong IS NOT NULL THEN wrong WHEN c IS NULL THEN 'invalid_timestamp' WHEN node_index IS NULL THEN 'author_not_in_frozen_universe' WHEN {_SNAP('c')} IS NULL THEN 'outside_canonical_snapshot_range' END AS e FROM n3)
SELECT CASE WHEN e IS NULL THEN 'retained' WHEN e IN ('author_not_in_frozen_universe', 'outside_canonical_snapshot_range') THEN 'excluded' ELSE 'rejected' END AS record_status, e AS exclusion_reason, count(*) AS rows FROM n4 GROUP BY ALL"""


@query(_NORMAL)
def normalize_status(spark, d):
    """What becomes of the raw rows, over all names a column has had."""
    return records.normalise(unified_sheet(spark, d), nodes(spark, d)).groupBy("record_status", "exclusion_reason").agg(F.count(F.lit(1)).alias("rows"))


@query(
    _SHEET + r" SELECT source_file, source_row_number, nfc_normalize(regexp_replace(replace(tx, chr(65279), ''), '\r\n?', chr(10), 'g')) AS text_normalized, count(*) AS rows FROM sh GROUP BY ALL"
)
def normalized_texts(spark, d):
    """The normalised texts of the raw rows, over all names the text column has had."""
    return normalized_text(unified_sheet(spark, d), "text", "text_normalized").groupBy("source_file", "source_row_number", "text_normalized").agg(F.count(F.lit(1)).alias("rows"))


@query(
    f"WITH {RECORDS} SELECT source_file, count(*) AS rows_in, count(*) FILTER (record_status = 'retained') AS retained, count(*) FILTER (record_status = 'excluded') AS excluded, count(*) FILTER (record_status = 'rejected') AS rejected, count(*) FILTER (record_status IS NULL) AS without_status FROM r GROUP BY 1"
)
def row_accounting(spark, d):
    return records.row_accounting(table(spark, d, "normalized_records"))


@query("SELECT text_quality, count(*) AS rows, min(text_normalized_len) AS shortest, max(text_normalized_len) AS longest, round(avg(text_normalized_len), 6) AS mean_length FROM normalized_records GROUP BY 1")
def text_quality_stats(spark, d):
    return records.text_quality_statistics(table(spark, d, "normalized_records"))


@query(f"WITH {RECORDS} SELECT snapshot_id, count(*) AS retained FROM r WHERE record_status = 'retained' GROUP BY 1")
def snapshot_statistics(spark, d):
    return plain_records(spark, d).where("record_status = 'retained'").groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("retained"))


# -- duplicates --------------------------------------------------------------------------------------

_GROUPS = rf"""WITH k AS (SELECT {_T('tweet_id')} AS key, author_account_id AS a, created_at_original AS c, text_raw AS x, source_file, source_row_number FROM normalized_records),
v AS (SELECT key, source_file, source_row_number, md5(coalesce(a, chr(1)) || chr(31) || coalesce(c, chr(1)) || chr(31) || coalesce(x, chr(1))) AS content FROM k WHERE regexp_full_match(key, '\d{{15,20}}')),
g AS (SELECT key, count(*) AS occurrences, count(DISTINCT content) AS contents, count(DISTINCT source_file) AS files, min({{'f': source_file, 'r': source_row_number}}) AS first,
  string_agg(source_file || ':' || source_row_number, ';' ORDER BY source_file, source_row_number) AS spots FROM v GROUP BY key)
"""


def post_groups(spark, d):
    return records.duplicate_groups(table(spark, d, "normalized_records"), tweet_id(F.col("tweet_id")), records.post_content())


@query(_GROUPS + "SELECT key, occurrences, contents, files, first.f AS canonical_source_file, first.r AS canonical_source_row_number FROM g")
def dup_groups(spark, d):
    return post_groups(spark, d)


@query(
    _GROUPS + "SELECT count(*) AS groups, count(*) FILTER (occurrences > 1) AS duplicate_groups, count(*) FILTER (occurrences > 1 AND contents = 1) AS concordant, count(*) FILTER (occurrences > 1 AND contents > 1) AS discordant, "
    "count(*) FILTER (occurrences > 1 AND files = 1) AS within_file, count(*) FILTER (occurrences > 1 AND files > 1) AS cross_file, CAST(sum(occurrences - 1) AS BIGINT) AS extra_rows FROM g"
)
def dup_summary(spark, d):
    return records.duplicate_summary(post_groups(spark, d))


@query(_GROUPS + "SELECT occurrences, count(*) AS groups FROM g GROUP BY 1")
def dup_multiplicity(spark, d):
    return records.multiplicity(post_groups(spark, d))


@query(_GROUPS + "SELECT key AS tweet_id, CASE WHEN contents = 1 THEN 'exact_duplicate' ELSE 'conflicting_id' END AS duplicate_type, occurrences AS occurrence_count, first.f AS canonical_source_file, first.r AS canonical_source_row_number, spots AS source_locations FROM g WHERE occurrences > 1")
def duplicate_report(spark, d):
    return records.duplicate_report(table(spark, d, "normalized_records"))


@query(
    _GROUPS + f"SELECT record_id, g.key IS NOT NULL AS is_duplicate, g.key IS NOT NULL AND g.first.f = n.source_file AND g.first.r = n.source_row_number AS is_canonical_duplicate FROM normalized_records n LEFT JOIN (FROM g WHERE occurrences > 1) g ON g.key = {_T('n.tweet_id')}"
)
def duplicate_flags(spark, d):
    return records.with_duplicate_flags(table(spark, d, "normalized_records")).select("record_id", "is_duplicate", "is_canonical_duplicate")


@query(
    _GROUPS + ", m AS (SELECT tweet_id, any_value(duplicate_type) AS t, any_value(occurrence_count) AS n FROM duplicate_report GROUP BY 1 HAVING count(*) = 1) "
    "SELECT CASE WHEN m.tweet_id IS NULL THEN 'missing_from_report' WHEN g.key IS NULL THEN 'not_in_records' WHEN m.n <> g.occurrences THEN 'wrong_count' WHEN (m.t = 'exact_duplicate') <> (g.contents = 1) THEN 'wrong_type' ELSE 'agrees' END AS outcome, count(*) AS posts "
    "FROM (FROM g WHERE occurrences > 1) g FULL JOIN m ON m.tweet_id = g.key GROUP BY 1"
)
def duplicate_report_check(spark, d):
    """How an earlier report compares with the records; posts it names several times count as missing."""
    own = post_groups(spark, d).where("occurrences > 1")
    old = table(spark, d, "duplicate_report").groupBy("tweet_id").agg(F.count(F.lit(1)).alias("k"), F.any_value("duplicate_type").alias("t"), F.any_value("occurrence_count").alias("n")).where("k = 1")
    outcome = (
        F.when(F.col("tweet_id").isNull(), "missing_from_report").when(F.col("key").isNull(), "not_in_records").when(F.col("n") != F.col("occurrences"), "wrong_count").when((F.col("t") == "exact_duplicate") != (F.col("contents") == 1), "wrong_type").otherwise("agrees")
    )
    return own.join(old, own["key"] == old["tweet_id"], "full").groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("posts"))


@query("SELECT n AS rows_of_user, count(*) AS users FROM (SELECT author_account_id, count(*) AS n FROM normalized_records WHERE author_account_id IS NOT NULL GROUP BY 1) GROUP BY 1")
def user_multiplicity(spark, d):
    per = table(spark, d, "normalized_records").where("author_account_id is not null").groupBy("author_account_id").agg(F.count(F.lit(1)).alias("rows_of_user"))
    return per.groupBy("rows_of_user").agg(F.count(F.lit(1)).alias("users"))


@query(
    f"SELECT sha256(text_normalized) AS text_hash, count(*) AS occurrences, count(DISTINCT author_account_id) AS authors, count(DISTINCT snapshot_id) AS snapshots FROM normalized_records WHERE NOT {_BLANK('text_normalized')} GROUP BY 1 HAVING count(*) > 1"
)
def repeated_texts(spark, d):
    return records.repeated_texts(table(spark, d, "normalized_records"))


@query("SELECT text_hash, count(*) AS events FROM (SELECT substr(sha256(cleaned_text), 1, 16) AS text_hash FROM graph_events WHERE cleaned_text IS NOT NULL) GROUP BY 1")
def text_hash_counts(spark, d):
    e = table(spark, d, "graph_events").where("cleaned_text is not null")
    return e.groupBy(hashing.content_hash(F.col("cleaned_text"), 16).alias("text_hash")).agg(F.count(F.lit(1)).alias("events"))


# -- lengths and coverage ----------------------------------------------------------------------------


def _lengths(t: str, text: str, by: str) -> str:
    q = ", ".join(f"round(quantile_cont(length({text}), {x}), 6) AS p{str(x * 100).rstrip('0').rstrip('.').replace('.', '_')}" for x in DEFAULT.quantiles)
    a = ", ".join(f"count(*) FILTER (length({text}) > {m}) AS above_{m}" for m in DEFAULT.max_lengths)
    return f"SELECT {by}, count(*) AS texts, max(length({text})) AS longest, {q}, {a} FROM {t} WHERE {text} IS NOT NULL GROUP BY {by}"


@query(_lengths("documents", "text", "lang"))
def text_length_by_lang(spark, d):
    return diagnostics.length_summary(table(spark, d, "documents"), "text", ["lang"])


@query(_lengths("graph_events", "cleaned_text", "relation_id"))
def text_length_by_relation(spark, d):
    return diagnostics.length_summary(table(spark, d, "graph_events"), "cleaned_text", ["relation_id"])


@query(_lengths("normalized_records", "text_normalized", "snapshot_id"))
def text_length_by_snapshot(spark, d):
    return diagnostics.length_summary(table(spark, d, "normalized_records"), "text_normalized", ["snapshot_id"])


@query(
    f"SELECT source_file, CASE WHEN text_raw IS NULL THEN 'null' WHEN text_raw = '' THEN 'empty' WHEN {_BLANK('text_raw')} THEN 'whitespace_only' ELSE 'ok' END AS text_class, count(*) AS rows FROM normalized_records GROUP BY ALL"
)
def text_class_counts(spark, d):
    return diagnostics.text_class_counts(table(spark, d, "normalized_records"), "text_raw", ["source_file"])


@query(f"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '{_WS}+'), lambda x: x <> '')) AS tokens FROM documents")
def whitespace_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", diagnostics.whitespace_tokens(F.col("text")).cast("bigint").alias("tokens"))


@query(
    "WITH o AS (SELECT length(text) AS n, row_number() OVER (ORDER BY length(text)) - 1 AS i, count(*) OVER () AS t FROM documents WHERE text IS NOT NULL) "
    "SELECT share, n AS value FROM o, (VALUES (0.5), (0.9), (0.99)) s(share) WHERE i = CAST(round_even((t - 1) * share, 0) AS BIGINT)"
)
def nearest_rank_lengths(spark, d):
    return diagnostics.nearest_rank(table(spark, d, "documents").select(F.length("text").alias("n")), "n").withColumn("share", F.col("share").cast("double"))


@query(
    f"WITH {INTERACTIONS} SELECT CASE WHEN a IS NULL OR created IS NULL OR relation_id IS NULL THEN 'missing_fields' WHEN relation_id NOT BETWEEN 0 AND 3 THEN 'invalid_relation' WHEN source_idx IS NULL THEN 'outside_universe' "
    "WHEN coalesce(source_idx = target_idx, false) OR (target_idx IS NULL AND coalesce(a = t, false)) THEN 'self_loop' ELSE 'accepted' END AS reason, count(*) AS rows FROM x GROUP BY 1"
)
def coverage_ladder(spark, d):
    return diagnostics.reason_counts(graph.indexed(interactions(spark, d), nodes(spark, d)), diagnostics.coverage_reason())


_COVER = f"""WITH {EDGES}, cal AS ({_CAL}), s AS (SELECT DISTINCT snapshot_id, src_index AS node_index FROM e UNION SELECT DISTINCT snapshot_id, dst_index FROM e),
t AS (SELECT DISTINCT snapshot_id, node_index FROM normalized_records WHERE lower({_T('record_status')}) = 'retained' AND NOT {_BLANK('text_normalized')} AND snapshot_id IS NOT NULL AND node_index IS NOT NULL),
f AS (SELECT coalesce(s.snapshot_id, t.snapshot_id) AS snapshot_id, s.node_index IS NOT NULL AS s, t.node_index IS NOT NULL AS t FROM s FULL JOIN t ON s.snapshot_id = t.snapshot_id AND s.node_index = t.node_index),
g AS (SELECT snapshot_id, count(*) FILTER (s AND NOT t) AS so, count(*) FILTER (t AND NOT s) AS tt, count(*) FILTER (s AND t) AS b, count(*) AS a FROM f GROUP BY 1)
SELECT cal.snapshot_id, label, coalesce(so, 0) AS structure_only, coalesce(tt, 0) AS text_only, coalesce(b, 0) AS "both", coalesce(a, 0) AS active, round(coalesce(a, 0) / 4000.0, 6) AS active_share FROM cal LEFT JOIN g ON g.snapshot_id = cal.snapshot_id"""


@query(_COVER)
def coverage_by_snapshot(spark, d):
    e = edges_of(spark, d)
    struct = e.select("snapshot_id", F.explode(F.array("src_index", "dst_index")).alias("node_index"))
    text = plain_records(spark, d).where((F.col("record_status") == "retained") & ~diagnostics.is_blank(F.col("text_normalized"))).select("snapshot_id", "node_index")
    return diagnostics.coverage_by_snapshot(struct, text, times.calendar(spark), 4000)


@query(f"WITH {EDGES}, cal AS ({_CAL}) SELECT snapshot_id, CAST(r AS INTEGER) AS relation_id FROM cal, range(4) t(r) WHERE (snapshot_id, r) NOT IN (SELECT (snapshot_id, relation_id) FROM e WHERE count_raw > 1)")
def coverage_relation_empty(spark, d):
    """Quarters and relations without an edge of more than one event."""
    return diagnostics.empty_relations(edges_of(spark, d).where("count_raw > 1"), times.calendar(spark))


@query(
    f"SELECT snapshot_id, CAST(relation_id AS INTEGER) AS relation_id, count(*) AS events, count(*) FILTER (NOT {_BLANK('cleaned_text')}) AS with_text, round(count(*) FILTER (NOT {_BLANK('cleaned_text')}) / count(*), 6) AS share "
    "FROM graph_events WHERE snapshot_id IS NOT NULL AND relation_id IS NOT NULL GROUP BY GROUPING SETS ((snapshot_id), (relation_id), (snapshot_id, relation_id))"
)
def text_coverage(spark, d):
    return diagnostics.text_coverage(table(spark, d, "graph_events"))


# -- profiles ----------------------------------------------------------------------------------------

_TYPE = r"""CASE WHEN s IS NULL OR s = '' THEN 'null' WHEN regexp_full_match(s, '[+-]?\d+') THEN 'integer' WHEN regexp_full_match(s, '[+-]?(\d+\.\d*|\.\d+|\d+(\.\d*)?[eE][+-]?\d+)') THEN 'float' WHEN lower(s) IN ('true', 'false') THEN 'boolean'
  WHEN regexp_full_match(s, '\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?.*)?') THEN 'date' WHEN regexp_full_match(s, '(?s)\{.*\}') THEN 'object' WHEN regexp_full_match(s, '(?s)\[.*\]') THEN 'list' ELSE 'string' END"""


_ALL_COLUMNS = (
    "record_id", "tweet_id", "author_account_id", "node_index", "created_at_original", "created_at_utc", "snapshot_id", "text_raw", "text_normalized", "text_quality", "text_raw_len", "text_normalized_len", *records.METRICS,
    "source_file", "source_sheet", "source_row_number", "record_status", "exclusion_reason", "is_duplicate", "is_canonical_duplicate", "collected_at",
)


@query(
    "WITH c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS v FROM normalized_records" for c in _ALL_COLUMNS) + "), "
    f"t AS (SELECT \"column\", v, trim(v, ' ') AS s FROM c), y AS (SELECT \"column\", v, {_TYPE} AS ty FROM t), "
    "b AS (SELECT \"column\", ty, row_number() OVER (PARTITION BY \"column\" ORDER BY count(*) DESC, ty) AS i FROM y WHERE ty <> 'null' GROUP BY \"column\", ty) "
    "SELECT y.\"column\", count(*) AS rows, count(*) FILTER (y.ty = 'null') AS nulls, count(DISTINCT CASE WHEN y.ty <> 'null' THEN v END) AS distinct_values, any_value(b.ty) AS type FROM y LEFT JOIN b ON b.\"column\" = y.\"column\" AND b.i = 1 GROUP BY y.\"column\""
)
def profile_columns(spark, d):
    """The profile of the whole table."""
    return profile.column_profile(table(spark, d, "normalized_records"))


@query(
    rf"""WITH v AS (SELECT tweet_id, author_account_id, created_at_original, {_T('created_at_original')} AS s FROM normalized_records),
e AS (SELECT *, CASE WHEN regexp_full_match(s, '[+-]?\d+(\.\d+)?([eE][+-]?\d+)?') THEN CAST(trunc(CASE WHEN abs(CAST(s AS DOUBLE)) > 1e12 THEN CAST(s AS DOUBLE) / 1000 ELSE CAST(s AS DOUBLE) END) AS BIGINT) END AS n FROM v),
w AS (SELECT *, CASE WHEN n > 1000000000 AND n < 4102444800 THEN n END AS t FROM e)
SELECT count(*) AS rows, count(DISTINCT tweet_id) AS distinct_keys, count(tweet_id) - count(DISTINCT tweet_id) AS duplicate_rows, count(DISTINCT author_account_id) AS distinct_users, count(t) AS valid_times, count(*) FILTER (created_at_original IS NOT NULL AND t IS NULL) AS invalid_times, min(t) AS first_epoch, max(t) AS last_epoch FROM w"""
)
def key_duplicates(spark, d):
    return profile.key_profile(table(spark, d, "normalized_records"), "tweet_id", "author_account_id", "created_at_original")


@query(
    r"SELECT CASE WHEN octet_length(encode(text)) = 0 THEN 'empty' WHEN regexp_matches(lower(substr(text, 1, 400)), '^\s*(<!doctype html|<html|<head|<script)') THEN 'html_page' WHEN lower(substr(text, 1, 2)) <> 'pk' THEN 'not_xlsx' ELSE 'ok' END AS verdict, count(*) AS documents FROM documents GROUP BY 1"
)
def html_detect(spark, d):
    t = table(spark, d, "documents").select(F.encode("text", "UTF-8").alias("b"))
    v = profile.download_verdict(F.col("b"), F.octet_length("b"), F.lit(None).cast("int"))
    return t.groupBy(v.alias("verdict")).agg(F.count(F.lit(1)).alias("documents"))


@query(r"SELECT 'acc:' || substr(sha256(author_account_id), 1, 16) AS account, regexp_extract(source_file, '([^/\\]*)$', 1) AS file, count(*) AS rows FROM normalized_records GROUP BY ALL")
def private_references(spark, d):
    r = table(spark, d, "normalized_records")
    return r.groupBy(hashing.private("acc", F.col("author_account_id")).alias("account"), hashing.file_reference(F.col("source_file")).alias("file")).agg(F.count(F.lit(1)).alias("rows"))


# -- eligibility and sampling ------------------------------------------------------------------------

_SPOTS = r"""sp AS (SELECT *, list_transform(string_split(source_locations, ';'), lambda x: {'f': regexp_extract(x, '^(.*):\d+$', 1), 'r': TRY_CAST(regexp_extract(x, ':(\d+)$', 1) AS BIGINT)}) AS s FROM duplicate_report),
cn AS (SELECT tweet_id, min({'f': canonical_source_file, 'r': canonical_source_row_number}) AS c FROM sp WHERE occurrence_count >= 2 AND len(s) = occurrence_count AND list_min(s).f = canonical_source_file AND list_min(s).r = canonical_source_row_number GROUP BY 1)"""
_REASON_OF = lambda c: f"CASE WHEN {c} IS NULL THEN 'null_text' WHEN {c} = '' THEN 'empty_text' WHEN {_BLANK(c)} THEN 'whitespace_only_text' END"
_NODE_UNITS = f"""WITH {RECORDS}, {_SPOTS}, nu AS (SELECT r.*, coalesce({_REASON_OF('text_normalized')}, CASE WHEN cn.tweet_id IS NOT NULL AND NOT (r.source_file = cn.c.f AND r.source_row_number = cn.c.r) THEN 'noncanonical_duplicate' END) AS reason,
  sha256('{selection.DOMAIN}' || chr(31) || 'node' || chr(31) || 'run' || chr(31) || coalesce(r.tweet_id, chr(0)) || chr(31) || r.source_file || chr(31) || r.source_row_number || chr(31)) AS unit_hash FROM r LEFT JOIN cn ON cn.tweet_id = r.tweet_id WHERE record_status = 'retained')"""


@query(_NODE_UNITS + " SELECT coalesce(reason, 'eligible') AS reason, count(*) AS units FROM nu GROUP BY 1")
def eligibility_report(spark, d):
    return selection.eligibility_report(selection.node_units(table(spark, d, "normalized_records"), table(spark, d, "duplicate_report")))


@query(_NODE_UNITS + " SELECT record_id, unit_hash, sha256(text_normalized) AS content_hash FROM nu WHERE reason IS NULL AND tweet_id IS NOT NULL")
def eligible_units(spark, d):
    u = selection.node_units(table(spark, d, "normalized_records"), table(spark, d, "duplicate_report"))
    return u.where("reason is null and tweet_id is not null").select("record_id", "unit_hash", "content_hash")


_EVENT_UNITS = f"""eu AS (SELECT *, coalesce({_REASON_OF('cleaned_text')}, CASE WHEN NOT starts_with(sha256(cleaned_text), coalesce(text_hash, '?')) THEN 'text_hash_mismatch' END) AS reason,
  sha256('{selection.DOMAIN}' || chr(31) || 'event' || chr(31) || 'run' || chr(31) || signature || chr(31)) AS unit_hash FROM (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY source_file, source_row_number) AS rn FROM graph_events) WHERE rn = 1)"""


def event_units(spark, d):
    return selection.event_units(table(spark, d, "graph_events").select("signature", "snapshot_id", "relation_id", "source_idx", "target_idx", "cleaned_text", "text_hash", "source_file", "source_row_number"))


@query(f"WITH {_EVENT_UNITS} SELECT coalesce(reason, 'eligible') AS reason, count(*) AS units FROM eu GROUP BY 1")
def event_eligibility_report(spark, d):
    return selection.eligibility_report(event_units(spark, d))


_ACTIVITY = """o AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS t FROM act), th AS (SELECT max(n) FILTER (i = (t - 1) // 3) AS low, max(n) FILTER (i = 2 * (t - 1) // 3) AS high FROM o)"""


@query(f"WITH act AS (SELECT source_idx, count(*) AS n FROM graph_events WHERE source_idx IS NOT NULL GROUP BY 1), {_ACTIVITY} SELECT low, high FROM th")
def activity_terciles(spark, d):
    a = table(spark, d, "graph_events").where("source_idx is not null").groupBy("source_idx").agg(F.count(F.lit(1)).alias("n"))
    return selection.activity_terciles(a)


_SAMPLE = f"""WITH {_EVENT_UNITS}, u AS (SELECT * FROM eu WHERE reason IS NULL AND source_idx IS NOT NULL), act AS (SELECT source_idx, count(*) AS n FROM u GROUP BY 1), {_ACTIVITY},
s AS (SELECT u.signature, u.unit_hash, snapshot_id, relation_id, CASE WHEN n <= low THEN 'low' WHEN n <= high THEN 'medium' ELSE 'high' END AS al, CASE WHEN length(cleaned_text) <= 64 THEN 'short' WHEN length(cleaned_text) <= 256 THEN 'medium' ELSE 'long' END AS ll,
  u.source_idx % 16 AS bk, sha256('{selection.SAMPLE_DOMAIN}' || chr(31) || '7' || chr(31) || u.unit_hash) AS pr FROM u JOIN act ON act.source_idx = u.source_idx, th),
w AS (SELECT *, row_number() OVER (PARTITION BY {{strata}} ORDER BY pr, unit_hash) AS a, row_number() OVER (PARTITION BY relation_id ORDER BY pr, unit_hash) AS b FROM s),
k AS (SELECT signature, {{tier}} AS tier, pr, unit_hash FROM w ORDER BY tier, pr, unit_hash LIMIT 100)
SELECT signature, CAST(tier AS INTEGER) AS tier FROM k"""


def sampled(spark, d, strata, forced=None):
    u = event_units(spark, d).where("reason is null and source_idx is not null")
    s = selection.with_strata(u, "source_idx", "cleaned_text")
    return selection.stratified_sample(s, strata, DEFAULT.sample_limit, forced).select("signature", "tier")


@query(_SAMPLE.replace("{strata}", "snapshot_id, al").replace("{tier}", "CASE WHEN a = 1 THEN 1 ELSE 2 END"))
def stratified_sample(spark, d):
    """A top-k report: the sample's size is the feature."""
    return sampled(spark, d, ["snapshot_id", "activity_level"])


@query(_SAMPLE.replace("{strata}", "ll, bk").replace("{tier}", "CASE WHEN b = 1 THEN 0 WHEN a = 1 THEN 1 ELSE 2 END"))
def forced_relation_sample(spark, d):
    """A top-k report in which every relation is present."""
    return sampled(spark, d, ["length_level", "bucket"], "relation_id")


@query("SELECT source_file, source_row_number, CAST(floor((row_number() OVER (ORDER BY source_file, source_row_number) - 1) / 512) AS BIGINT) AS batch FROM graph_events")
def shard_batches(spark, d):
    e = table(spark, d, "graph_events").select("source_file", "source_row_number")
    return selection.batch_numbers(e, ["source_file", "source_row_number"], 512)


_MARK = lambda seed: f"substr(sha256(snapshot_id || ',' || relation_id || ',' || src_index || ',' || dst_index || ',{seed}'), 1, 16)"


@query(f"WITH {EDGES}, m AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, relation_id, dst_index ORDER BY {_MARK(7)}, src_index, dst_index) AS i FROM e) SELECT snapshot_id, relation_id, src_index, dst_index FROM m WHERE i <= 3")
def fanout_topk(spark, d):
    """At most three incoming edges per node, relation and snapshot, drawn by hash."""
    return selection.fanout(edges_of(spark, d), "dst_index", 3).select(*graph.EDGE)


@query(
    f"WITH {EDGES}, m AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY {_MARK(8)}, relation_id, src_index, dst_index) AS i, count(*) OVER (PARTITION BY snapshot_id) AS n FROM e) "
    "SELECT snapshot_id, relation_id, src_index, dst_index, n >= 2 AND i <= greatest(round_even(n * 0.15, 0), 1) AS masked FROM m"
)
def edge_split(spark, d):
    return selection.split_edges(edges_of(spark, d), 0.15).select(*graph.EDGE, "masked")


@query(f"WITH a AS (SELECT DISTINCT {_T('author_account_id')} AS id FROM normalized_records) SELECT count(*) FILTER (regexp_full_match(id, '\\d+')) AS valid, count(*) FILTER (id IS NULL OR NOT regexp_full_match(id, '\\d+')) AS invalid FROM a")
def account_id_check(spark, d):
    ids = table(spark, d, "normalized_records").select(account_key(F.col("author_account_id")).alias("raw")).distinct()
    ok = account_id(F.col("raw")).isNotNull()
    return ids.agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))
