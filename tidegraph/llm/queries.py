"""Queries of the training-text problems and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegraph.llm import language, mixing, neardup, packing, pii, residue, survivor
from tidegraph.llm.tokens import with_tokens
from tidegraph.sources.tables import table

QUERIES = {}
SQL = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark, d):
    t = lambda name: table(spark, d, name)
    return pii.found(t("graph_events"), t("normalized_records"), t("given_names"), t("lang_samples"))


@query
def p1_redacted(spark, d):
    t = lambda name: table(spark, d, name)
    rows = pii.both_sources(t("graph_events"), t("normalized_records"))
    return pii.scan(rows, t("given_names"), t("lang_samples"), "text", redacted=True).where("spans > 0").drop("text")


@query
def p3_found(spark, d):
    t = lambda name: table(spark, d, name)
    rows = language.unlabelled(t("graph_events"), t("normalized_records"), t("lang_samples"))
    return rows.select("source_table", "row_id", "segment_no", "lang")


@query
def p3_language_report(spark, d):
    """Texts by the language their label names and the one found, with the mean confidence."""
    t = lambda name: table(spark, d, name)
    rows = language.detect(language.both_sources(t("graph_events"), t("normalized_records")), "text", t("lang_samples"))
    first = F.get("segments", F.lit(0))
    return rows.groupBy(
        "source_table", "label", F.when(F.size("segments") == 1, first["lang"]).when(F.size("segments") > 1, F.lit("mixed")).alias("found")
    ).agg(F.count(F.lit(1)).alias("texts"), F.round(F.avg(first["confidence"]), 3).alias("confidence"))


@query
def p4_found(spark, d):
    pairs = neardup.similar_pairs(table(spark, d, "graph_events"), "text_hash", "cleaned_text")
    return pairs.select(F.col("a").alias("text_hash_a"), F.col("b").alias("text_hash_b"))


@query
def p4_groups(spark, d):
    return neardup.duplicate_groups(table(spark, d, "graph_events"), "text_hash", "cleaned_text").withColumnsRenamed({"key": "text_hash", "group": "group_hash"})


@query
def p5_found(spark, d):
    return survivor.best_locations(table(spark, d, "normalized_records"))


@query
def p5_consolidated(spark, d):
    """One record per post with every column of the records."""
    return survivor.consolidate(table(spark, d, "normalized_records"))


@query
def p8_containers(spark, d):
    docs = with_tokens(table(spark, d, "documents").select("doc_id", "text"), "text").drop("text")
    packed = packing.pack(packing.items(docs, table(spark, d, "container_sizes")))
    return packed.select("container_kind", "container_id", "doc_id", "piece", "first_token", F.col("size").alias("tokens"))


@query
def p8_certificate(spark, d):
    docs = with_tokens(table(spark, d, "documents").select("doc_id", "text"), "text").drop("text")
    return packing.certificate(packing.pack(packing.items(docs, table(spark, d, "container_sizes"))))


@query
def p9_mix(spark, d):
    docs = with_tokens(table(spark, d, "documents").select("doc_id", "text", "source"), "text")
    return mixing.mix(docs, table(spark, d, "mix_targets"))


@query
def p9_shares(spark, d):
    docs = with_tokens(table(spark, d, "documents").select("doc_id", "text", "source"), "text")
    targets = table(spark, d, "mix_targets")
    return mixing.shares(mixing.mix(docs, targets), targets)


@query
def p10_found(spark, d):
    ordinary = residue.ordinary_words(table(spark, d, "lang_samples"))
    docs = residue.flagged(table(spark, d, "documents"), "text", "source", ordinary=ordinary, columns=["doc_id"])
    return docs.where("reason is not null").select("doc_id")


@query
def p10_clean_documents(spark, d):
    """The documents without residue: the corpus that goes on."""
    ordinary = residue.ordinary_words(table(spark, d, "lang_samples"))
    docs = residue.flagged(table(spark, d, "documents"), "text", "source", ordinary=ordinary)
    return docs.where("reason is null").drop("reason")


_POST = (
    "CASE WHEN regexp_replace(s, '[^0-9]', '', 'g') <> '' AND NOT regexp_matches(s, '[0-9]\\s*[.٫．]|[.٫．]\\s*[0-9]|[0-9]\\s*[eE]\\s*[+-]?\\s*[0-9]') "
    "THEN regexp_replace(s, '[^0-9]', '', 'g') END"
)
_WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1c-\x1f]"
_RECORDS = f"""
WITH n AS (SELECT *, translate(tweet_id, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹０１２３４５６７８９', '012345678901234567890123456789') AS s,
  lower(regexp_replace(record_status, '^{_WS}+|{_WS}+$', '', 'g')) AS st FROM normalized_records),
r AS (SELECT *, {_POST} AS post, CASE st WHEN 'retained' THEN 0 WHEN 'excluded' THEN 1 WHEN 'rejected' THEN 2 ELSE 3 END AS status FROM n),
l AS (SELECT post, 'likes' AS field_name, CAST(likes AS VARCHAR) AS value, status, collected_at, source_file, source_row_number FROM r
  UNION ALL SELECT post, 'views', CAST(views AS VARCHAR), status, collected_at, source_file, source_row_number FROM r
  UNION ALL SELECT post, 'text_raw', CASE WHEN regexp_full_match(text_raw, '{_WS}*') THEN NULL ELSE text_raw END, status, collected_at, source_file, source_row_number FROM r),
"""
SQL["p5_found"] = _RECORDS + """
k AS (SELECT *, count(*) OVER (PARTITION BY post, field_name) AS n, row_number() OVER (PARTITION BY post, field_name
  ORDER BY value IS NULL, status, collected_at DESC NULLS LAST, source_file, source_row_number) AS i FROM l WHERE post IS NOT NULL)
SELECT post AS tweet_id, field_name, source_file AS canonical_source_file, source_row_number AS canonical_source_row_number FROM k WHERE n >= 2 AND i = 1 AND value IS NOT NULL
"""
_TEXTS = ("author_account_id", "created_at_original", "text_raw", "text_normalized", "text_quality", "source_file", "source_sheet", "record_status", "exclusion_reason")
_TYPED = {
    "record_id": "BIGINT", "node_index": "INTEGER", "created_at_utc": "TIMESTAMPTZ", "snapshot_id": "INTEGER", "text_raw_len": "BIGINT", "text_normalized_len": "BIGINT", "likes": "BIGINT", "retweets": "BIGINT", "reply_count": "BIGINT",
    "quoted_count": "BIGINT", "bookmarks": "BIGINT", "views": "BIGINT", "source_row_number": "BIGINT", "is_duplicate": "BOOLEAN", "is_canonical_duplicate": "BOOLEAN", "collected_at": "TIMESTAMPTZ",
}
_ALL_LONG = " UNION ALL ".join(
    [f"SELECT post, '{c}' AS field_name, CASE WHEN regexp_full_match({c}, '{_WS}*') THEN NULL ELSE {c} END AS value, status, collected_at FROM r" for c in _TEXTS]
    + [f"SELECT post, '{c}', CAST({c} AS VARCHAR), status, collected_at FROM r" for c in _TYPED]
)
SQL["p5_consolidated"] = _RECORDS.split("l AS (")[0] + f"""l AS ({_ALL_LONG}),
v AS (SELECT post, field_name, regexp_replace(value, '^{_WS}+|{_WS}+$', '', 'g') AS value, CASE WHEN value IS NOT NULL THEN [1.0, 0.5, 0.25, 0.125][status + 1]
  * pow(0.5, coalesce((epoch(TIMESTAMP '2026-07-01') - epoch(collected_at)) / 86400.0, 3650.0) / 365.0) END AS vote FROM l WHERE post IS NOT NULL),
t AS (SELECT post, field_name, value, round(sum(vote), 9) AS votes, count(*) AS n FROM v GROUP BY ALL),
w AS (SELECT post, field_name, value, sum(n) OVER (PARTITION BY post, field_name) AS n,
  row_number() OVER (PARTITION BY post, field_name ORDER BY value IS NULL, votes DESC, value) AS i FROM t)
SELECT post AS tweet_id, CAST(max(n) AS BIGINT) AS occurrences, """ + ", ".join(
    [f"max(CASE WHEN field_name = '{c}' THEN value END) AS {c}" for c in _TEXTS] + [f"CAST(max(CASE WHEN field_name = '{c}' THEN value END) AS {k}){' AT TIME ZONE ' + repr('UTC') if k == 'TIMESTAMPTZ' else ''} AS {c}" for c, k in _TYPED.items()]
) + " FROM w WHERE i = 1 GROUP BY post"
SQL["p4_found"] = r"""
WITH t AS (SELECT text_hash AS h, min(cleaned_text) AS x FROM graph_events WHERE text_hash IS NOT NULL AND cleaned_text IS NOT NULL GROUP BY 1),
w AS (SELECT DISTINCT h, lower(unnest(regexp_extract_all(x, '[\p{L}\p{N}]+'))) AS w FROM t),
s AS (SELECT h, count(*) AS n FROM w GROUP BY h HAVING count(*) >= 8),
c AS (SELECT a.h AS a, b.h AS b, count(*) AS k FROM w a JOIN w b ON a.w = b.w AND a.h < b.h GROUP BY 1, 2)
SELECT a AS text_hash_a, b AS text_hash_b FROM c JOIN s x ON x.h = a JOIN s y ON y.h = b WHERE 10 * k >= 7 * (x.n + y.n - k)
"""
SQL["p4_groups"] = (
    SQL["p4_found"].replace("WITH t AS", "WITH RECURSIVE t AS").replace("SELECT a AS text_hash_a, b AS text_hash_b FROM c", ", p AS (SELECT a, b FROM c").rstrip().replace("\n, p AS", ",\np AS")
    + "),\ne AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r(n, m) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.n)\n"
    "SELECT n AS text_hash, min(m) AS group_hash, (SELECT count(*) FROM e WHERE e.a = r.n) AS links FROM r GROUP BY n"
)
