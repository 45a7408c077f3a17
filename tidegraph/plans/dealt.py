"""Queries of the general data problems (2, 6 and 7) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegraph.operators import drift, skew, timestamps
from tidegraph.sources.tables import table

QUERIES = {}
SQL = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p2_found(spark, d):
    return drift.changes(table(spark, d, "dataset_b_raw"))


@query
def p2_unified(spark, d):
    return drift.unify(table(spark, d, "dataset_b_raw"), table(spark, d, "schema_registry"))


@query
def p2_unified_values(spark, d):
    """The unified table's columns of the contract, and how many branches and extras each row has."""
    u = p2_unified(spark, d)
    held = sum((F.size(f"branches.{k}") for k in drift.BRANCHES), F.lit(0))
    return u.withColumns({"branch_values": held, "extra_columns": F.size("extras")}).drop("branches", "extras")


@query
def p2_alternatives(spark, d):
    return drift.alternatives(table(spark, d, "dataset_b_raw"), table(spark, d, "schema_registry"))


@query
def p6_found(spark, d):
    done = timestamps.normalise_timestamps(table(spark, d, "graph_events").select("event_id", "source_file", "created_at_utc_iso"), table(spark, d, "calendar_sources"))
    return done.where(~F.col("already_normal")).select("event_id", "outcome")


@query
def p6_invalid_by_file(spark, d):
    done = timestamps.normalise_timestamps(table(spark, d, "graph_events").select("source_file", "created_at_utc_iso"), table(spark, d, "calendar_sources"))
    return done.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("rows_inspected"),
        F.count_if(F.col("outcome") == "invalid_timestamp").alias("invalid_timestamp"),
        F.count_if(F.col("already_normal")).alias("already_normal"),
    )


@query
def p7_found(spark, d):
    return skew.heavy_accounts(table(spark, d, "graph_events"), table(spark, d, "node_universe")).select("role", "account_id")


@query
def p7_account_profile(spark, d):
    return skew.account_profile(table(spark, d, "graph_events"), table(spark, d, "node_universe"))


@query
def p7_reply_chances(spark, d):
    """Per account: rows of the join of what it wrote with what it received, and the text lengths over them."""
    e = table(spark, d, "graph_events")
    size = F.length("cleaned_text").alias("chars")
    wrote = e.select(skew.account_key(F.col("author_account_id")).alias("account_id"), size)
    got = e.select(skew.account_key(F.col("target_account_id")).alias("account_id"), F.length("cleaned_text").alias("chars_in"))
    return skew.eager_join_aggregate(wrote, got, "account_id", ["chars"], ["chars_in"])


_TRIM = r"nullif(regexp_replace({c}, '^[\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x1c-\x1f]+|[\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x1c-\x1f]+$', '', 'g'), '')"
_ROLES = f"""
WITH e AS (SELECT {_TRIM.format(c='author_account_id')} AS a, {_TRIM.format(c='target_account_id')} AS t, relation_id FROM graph_events),
r AS (SELECT 'author' AS role, a AS account_id, t AS other, relation_id FROM e UNION ALL SELECT 'target', t, a, relation_id FROM e),
s AS (SELECT role, account_id, count(*) AS events, count(DISTINCT other) AS counterparts,
  count(*) FILTER (relation_id = 0) AS mention, count(*) FILTER (relation_id = 1) AS retweet,
  count(*) FILTER (relation_id = 2) AS reply, count(*) FILTER (relation_id = 3) AS quote
  FROM r WHERE account_id IS NOT NULL GROUP BY role, account_id)
"""
SQL["p7_found"] = _ROLES + "SELECT role, account_id FROM s WHERE events * 100 >= (SELECT count(*) FROM graph_events)"
SQL["p7_account_profile"] = _ROLES + (
    "SELECT role, s.account_id, node_index, events, counterparts, mention, retweet, reply, quote FROM s LEFT JOIN node_universe n ON s.account_id = n.account_id"
)
SQL["p7_reply_chances"] = f"""
WITH w AS (SELECT {_TRIM.format(c='author_account_id')} AS account_id, length(cleaned_text) AS chars FROM graph_events),
g AS (SELECT {_TRIM.format(c='target_account_id')} AS account_id, length(cleaned_text) AS chars_in FROM graph_events)
SELECT account_id, CAST(sum(nl * nr) AS BIGINT) AS rows, CAST(sum(cl * nr) AS BIGINT) AS sum_chars, CAST(sum(cr * nl) AS BIGINT) AS sum_chars_in
FROM (SELECT account_id, count(*) AS nl, sum(chars) AS cl FROM w WHERE account_id IS NOT NULL GROUP BY 1)
JOIN (SELECT account_id, count(*) AS nr, sum(chars_in) AS cr FROM g WHERE account_id IS NOT NULL GROUP BY 1) USING (account_id) GROUP BY account_id
"""

#: The instants as named steps, so that other queries can begin with them too.
INSTANTS = r"""ts_z AS (SELECT source_file, min(timezone_assumption) AS a FROM calendar_sources GROUP BY 1),
ts_f AS (SELECT source_file, CASE WHEN a IS NULL OR upper(trim(a)) IN ('', 'UTC', 'GMT', 'Z') THEN '+00:00' WHEN regexp_matches(a, '^[A-Za-z]+/') THEN a
  ELSE regexp_extract(a, '([+-])', 1) || lpad(regexp_extract(a, '[+-](\d{1,2})', 1), 2, '0') || ':' || CASE WHEN a LIKE '%:%' THEN right(a, 2) ELSE '00' END END AS zone FROM ts_z),
ts_t AS (SELECT event_id, e.source_file, created_at_utc_iso AS raw, coalesce(zone, '+00:00') AS zone, regexp_replace(trim(translate(created_at_utc_iso, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789'), chr(32) || chr(9) || chr(10) || chr(13) || chr(160)), '^[A-Z][a-z]{2} ([A-Z][a-z]{2} \d{2} \d{2}:\d{2}:\d{2}) ([+-]\d{4}) (\d{4})$', '\1 \3\2') AS s FROM graph_events e LEFT JOIN ts_f USING (source_file)),
ts_u AS (SELECT *, CASE WHEN regexp_matches(s, '[AP]M$') OR NOT regexp_matches(s, '\d:?\d{2}') THEN '' ELSE regexp_extract(s, '( ?[A-Z]{1,4}|(?:\d{2}:\d{2}(?:\.\d+)?|\d{2}:\d{2} ?| \d{4})[ ]?[+-]\d{2}:?\d{2})$', 1) END AS tail FROM ts_t),
ts_v AS (SELECT *, CASE WHEN regexp_matches(tail, '[+-]') THEN regexp_extract(tail, '([+-]\d{2}:?\d{2})$', 1) ELSE trim(tail) END AS w FROM ts_u),
ts_x AS (SELECT *, CASE w WHEN '' THEN NULL WHEN 'Z' THEN '+00:00' WHEN 'UTC' THEN '+00:00' WHEN 'GMT' THEN '+00:00' WHEN 'CET' THEN '+01:00' WHEN 'CEST' THEN '+02:00' WHEN 'KST' THEN '+09:00' WHEN 'EST' THEN '-05:00' WHEN 'EDT' THEN '-04:00' WHEN 'PST' THEN '-08:00'
  ELSE CASE WHEN regexp_matches(w, '^[+-]') THEN left(w, 3) || ':' || right(w, 2) END END AS written, rtrim(left(s, length(s) - length(w))) AS base FROM ts_v),
ts_y AS (SELECT *, CASE WHEN w <> '' AND written IS NULL THEN NULL ELSE try_strptime(base, ['%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%dT%H:%M:%S.%f', '%Y-%m-%d', '%Y/%m/%d %H:%M:%S', '%d.%m.%Y %H:%M', '%m/%d/%Y %I:%M %p', '%b %d %H:%M:%S %Y', '%a, %d %b %Y %H:%M:%S', '%d %B %Y, %H:%M', '%Y%m%dT%H%M%S']) END AS local, coalesce(written, zone) AS zz FROM ts_x),
ts_g AS (SELECT *, CASE WHEN regexp_full_match(s, '-?\d+(\.\d+)?') THEN make_timestamp(CAST(floor(CAST(s AS DECIMAL(28, 6)) * CASE WHEN abs(CAST(s AS DOUBLE)) < 1e11 THEN 1000000 WHEN abs(CAST(s AS DOUBLE)) < 1e14 THEN 1000 ELSE 1 END) AS BIGINT))
  WHEN local IS NULL THEN NULL WHEN regexp_matches(zz, '^[+-]') THEN local - to_minutes(CAST((CASE WHEN zz LIKE '-%' THEN -1 ELSE 1 END) * (CAST(substr(zz, 2, 2) AS INTEGER) * 60 + CAST(substr(zz, 5, 2) AS INTEGER)) AS INTEGER))
  ELSE CAST(timezone('UTC', CASE WHEN timezone(zz, timezone(zz, local) - INTERVAL 1 HOUR) = local THEN timezone(zz, local) - INTERVAL 1 HOUR ELSE timezone(zz, local) END) AS TIMESTAMP) END AS i FROM ts_y),
ts_o AS (SELECT event_id, source_file, CASE WHEN i >= TIMESTAMP '2006-03-21' AND i < TIMESTAMP '2026-07-01' THEN i END AS instant, coalesce(regexp_full_match(raw, '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\+00:00'), false) AS form FROM ts_g)"""
_OUTCOMES = f"""
WITH {INSTANTS},
o AS (SELECT event_id, source_file, coalesce(strftime(instant, '%Y-%m-%dT%H:%M:%S.%fZ'), 'invalid_timestamp') AS outcome, form FROM ts_o)
"""
SQL["p6_found"] = _OUTCOMES + "SELECT event_id, outcome FROM o WHERE NOT (form AND outcome <> 'invalid_timestamp')"
SQL["p6_invalid_by_file"] = _OUTCOMES + (
    "SELECT source_file, count(*) AS rows_inspected, count(*) FILTER (outcome = 'invalid_timestamp') AS invalid_timestamp, count(*) FILTER (form AND outcome <> 'invalid_timestamp') AS already_normal FROM o GROUP BY 1"
)

_COLUMNS = r"""
WITH c AS (SELECT feed_id, file_seq, source_file, source_row_number, record_json AS j, unnest(json_keys(record_json)) AS name, unnest(range(len(json_keys(record_json)))) AS place FROM dataset_b_raw),
d AS (SELECT *, json_extract(j, '$."' || name || '"') AS v FROM c),
k AS (SELECT * EXCLUDE (v, j), md5(j) AS h, CASE json_type(v) WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DOUBLE' THEN 'fraction' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'integer' END AS type, json_extract_string(j, '$."' || name || '"') AS x FROM d),
n AS (SELECT feed_id, file_seq, source_file, name, type, count(*) AS n, max(place) AS place, count(*) FILTER (regexp_full_match(x, '\d{15,20}')) AS ids FROM k GROUP BY ALL),
p AS (SELECT feed_id, file_seq, source_file, name, max(place) AS place, arg_min(type, {'n': -n, 't': type}) FILTER (type IS NOT NULL) AS type, sum(n) FILTER (type IS NOT NULL) AS rows, sum(ids) AS ids FROM n GROUP BY ALL),
s AS (SELECT *, lag(source_file) OVER (PARTITION BY feed_id ORDER BY file_seq) AS prev FROM (SELECT DISTINCT feed_id, file_seq, source_file FROM dataset_b_raw)),
i AS (SELECT source_file, arg_min(name, place) AS name FROM p WHERE ids * 2 > rows GROUP BY 1),
r AS (SELECT DISTINCT k.source_file, source_row_number, h, x AS post FROM k JOIN i ON i.source_file = k.source_file AND i.name = k.name WHERE regexp_full_match(x, '\d{15,20}')),
m AS (SELECT k.source_file, post, name, min(x) AS x FROM k JOIN r USING (source_file, source_row_number, h) GROUP BY ALL),
f AS (SELECT s.source_file, s.prev, coalesce(a.name, b.name) AS name, a.place AS place, b.place AS prev_place, a.type AS type, b.type AS prev_type FROM s JOIN LATERAL (SELECT DISTINCT name FROM p WHERE p.source_file IN (s.source_file, s.prev)) q ON true
  LEFT JOIN p a ON a.source_file = s.source_file AND a.name = q.name LEFT JOIN p b ON b.source_file = s.prev AND b.name = q.name WHERE s.prev IS NOT NULL),
e AS (SELECT g.source_file, g.name AS old, w.name AS new, count(*) FILTER (mo.x = mn.x) AS equal, count(*) FILTER (mo.x IS NOT NULL OR mn.x IS NOT NULL) AS compared FROM f g JOIN m mo ON mo.source_file = g.prev AND mo.name = g.name JOIN f w ON w.source_file = g.source_file AND w.prev_place IS NULL
  JOIN m mn ON mn.source_file = w.source_file AND mn.name = w.name AND mn.post = mo.post WHERE g.place IS NULL GROUP BY ALL),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_file, old ORDER BY equal / compared DESC, equal DESC, new) AS a, row_number() OVER (PARTITION BY source_file, new ORDER BY equal / compared DESC, equal DESC, old) AS b FROM e WHERE equal > 0 AND equal * 10 >= compared * 6) WHERE a = 1 AND b = 1),
l AS (SELECT f.source_file, f.name, f.place, f.prev_place, f.type, f.prev_type, false AS renamed FROM f WHERE place IS NOT NULL AND prev_place IS NOT NULL
  UNION ALL SELECT t.source_file, t.new, w.place, g.prev_place, w.type, g.prev_type, true FROM t JOIN f w ON w.source_file = t.source_file AND w.name = t.new JOIN f g ON g.source_file = t.source_file AND g.name = t.old),
o AS (SELECT source_file, list(name ORDER BY place) <> list(name ORDER BY prev_place) AS moved FROM l GROUP BY 1)
SELECT source_file, 'removed' AS change_type, name AS column_name FROM f WHERE place IS NULL AND (source_file, name) NOT IN (SELECT (source_file, old) FROM t)
UNION ALL SELECT source_file, 'added', name FROM f WHERE prev_place IS NULL AND (source_file, name) NOT IN (SELECT (source_file, new) FROM t)
UNION ALL SELECT source_file, 'renamed', new FROM t UNION ALL SELECT source_file, 'retyped', name FROM l WHERE type <> prev_type UNION ALL SELECT source_file, 'reordered', '*' FROM o WHERE moved
"""
SQL["p2_found"] = _COLUMNS

_PLAIN = lambda c: f"regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_CANONICAL = _COLUMNS.split("\nSELECT source_file, 'removed'")[0].replace("WITH c AS", "WITH RECURSIVE c AS") + f""",
k1 AS (SELECT f.source_file, f.name, f.prev, f.name AS prev_name FROM f WHERE place IS NOT NULL AND prev_place IS NOT NULL UNION ALL SELECT t.source_file, t.new, s.prev, t.old FROM t JOIN s ON s.source_file = t.source_file),
z(source_file, name, af, an) AS (SELECT source_file, name, source_file, name FROM p UNION ALL SELECT z.source_file, z.name, k1.prev, k1.prev_name FROM z JOIN k1 ON k1.source_file = z.af AND k1.name = z.an),
rt AS (SELECT z.* FROM z ANTI JOIN k1 ON k1.source_file = z.af AND k1.name = z.an),
ct AS (SELECT {_PLAIN('column_name')} AS key, min(column_name) AS kept FROM schema_registry GROUP BY 1),
c0 AS (SELECT rt.source_file, rt.name, coalesce(kept, an) AS canonical, place FROM rt LEFT JOIN ct ON ct.key = {_PLAIN('an')} JOIN p ON p.source_file = rt.source_file AND p.name = rt.name),
cn AS (SELECT source_file, name, CASE WHEN row_number() OVER (PARTITION BY source_file, canonical ORDER BY CAST(name <> canonical AS INTEGER), place, name) = 1 THEN canonical ELSE name END AS canonical FROM c0)"""
SQL["p2_alternatives"] = _CANONICAL + """,
nt AS (SELECT DISTINCT k.rn, k.feed_id, k.file_seq, k.source_file, k.name, replace(regexp_replace(substr(j.fullkey, 2), '\\[\\d+\\]', '[]', 'g'), '"', '') AS path,
  CASE j.type WHEN 'NULL' THEN 'null' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DOUBLE' THEN 'fraction' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'integer' END AS type
  FROM (SELECT *, row_number() OVER () AS rn FROM k WHERE type IN ('object', 'array')) k, json_tree(k.x) j WHERE j.fullkey <> '$'),
tp AS (SELECT feed_id, file_seq, source_file, name, '' AS path, type, n FROM n UNION ALL SELECT feed_id, file_seq, source_file, name, path, type, count(*) FROM nt GROUP BY ALL)
SELECT a.feed_id, canonical || a.path AS canonical, a.type, CAST(sum(a.n) AS BIGINT) AS "values", count(DISTINCT a.source_file) AS files, min(a.file_seq) AS first_seq FROM tp a JOIN cn ON cn.source_file = a.source_file AND cn.name = a.name WHERE a.type IS NOT NULL GROUP BY 1, 2, 3
"""
# The contract's columns, which SQL has to name.
_CONTRACT = {c: "string" for c in ("id", "created_at", "user", "text")} | {c: "integer" for c in ("likes", "retweets", "reply_count", "quoted_count", "bookmarks", "views")}
_WHOLE = "coalesce(CASE WHEN regexp_full_match({x}, '\\s*[+-]?\\d+\\s*') THEN TRY_CAST({x} AS BIGINT) END, TRY_CAST(trunc(TRY_CAST({x} AS DOUBLE)) AS BIGINT))"
_OF = lambda c: f"max(CASE WHEN canonical = '{c}' THEN x END)"
CELLS = _CANONICAL + f""",
vs AS (SELECT k.feed_id, k.file_seq, k.source_file, source_row_number, h, k.name, canonical, x, type, k.place, canonical IN ({', '.join(f"'{c}'" for c in _CONTRACT)}) AS inside FROM (SELECT DISTINCT * FROM k) k JOIN cn ON cn.source_file = k.source_file AND cn.name = k.name),
fs AS (SELECT *, row_number() OVER (PARTITION BY source_file, source_row_number, h, canonical ORDER BY x IS NULL, place) = 1 AND inside AS own FROM vs)"""
SQL["p2_unified_values"] = CELLS + f"""
SELECT feed_id, file_seq, source_file, source_row_number, {', '.join((_WHOLE.format(x=_OF(c).replace('THEN x', 'AND own THEN x')) if t == 'integer' else _OF(c).replace('THEN x', 'AND own THEN x')) + f' AS "{c}"' for c, t in _CONTRACT.items())},
  CAST(count(*) FILTER (own AND x IS NOT NULL AND type <> CASE WHEN canonical IN ('id', 'created_at', 'user', 'text') THEN 'string' ELSE 'integer' END) AS INTEGER) AS branch_values, CAST(count(DISTINCT name) FILTER (x IS NOT NULL AND NOT own) AS INTEGER) AS extra_columns
FROM fs GROUP BY feed_id, file_seq, source_file, source_row_number, h
"""
