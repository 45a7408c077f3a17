"""Schemas of the tables that pass between the stages."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidegraph.config import FEATURES




NORMALIZED = (
    "tweet_id string, author_account_id string, node_index int, created_at_original string, created_at_utc timestamp, snapshot_id int, text_raw string, text_normalized string, "
    "text_quality string, text_raw_len bigint, text_normalized_len bigint, likes bigint, retweets bigint, reply_count bigint, quoted_count bigint, bookmarks bigint, views bigint, "
    "source_file string, source_sheet string, source_row_number bigint, record_status string, exclusion_reason string, is_duplicate boolean, is_canonical_duplicate boolean"
)
EVENTS = "signature string, snapshot_id int, relation_id tinyint, source_idx int, target_idx int, cleaned_text string, text_hash string, text_quality string, source_file string, source_row_number bigint"
AUTHORED = "source_file string, source_row_number bigint, snapshot_id int, source_idx int"
EDGES = "snapshot_id int, relation_id tinyint, src_index int, dst_index int, count_raw bigint, weight_log1p double"
DUPLICATES = "tweet_id string, duplicate_type string, occurrence_count bigint, canonical_source_file string, canonical_source_row_number bigint, source_locations string"
UNITS = (
    "modality string, source_run_id string, unit_id string, unit_hash string, content_hash string, preprocessing_hash string, cleaned_text string, snapshot_id int, node_index int, "
    "relation_id tinyint, source_idx int, target_idx int, source_file string, source_sheet string, source_row_number bigint"
)
NODES = "account_id string, node_index int"
X_STRUCT = "snapshot_id int, node_index int, " + ", ".join(f"{f} float" for f in FEATURES) + ", struct_active boolean"
#: The ten columns of a raw text sheet, in their exact order.
TEXT_SHEET = ("id", "created_at", "user", "text", "likes", "retweets", "reply_count", "quoted_count", "bookmarks", "views")
#: The columns a raw graph sheet must have.
GRAPH_SHEET = ("id", "created_at", "user", "text", "user_mentions", "retweeted_status", "reply_status", "quoted_status")


def mismatches(df: DataFrame, ddl: str) -> list[str]:
    """What keeps ``df`` from having the columns of a schema, as sentences; [] if nothing does."""
    have = dict(df.dtypes)
    out = []
    for part in ddl.split(", "):
        name, kind = part.rsplit(" ", 1)
        if name not in have:
            out.append(f"{name} is missing")
        elif have[name] != kind:
            out.append(f"{name} is {have[name]}, not {kind}")
    return out


def exact_columns(columns: list[str], expected: tuple[str, ...]) -> dict[str, object]:
    """Whether the columns are the expected ones in their order, and which are missing or unexpected."""
    return {"matches": tuple(columns) == tuple(expected), "missing": [c for c in expected if c not in columns], "unexpected": [c for c in columns if c not in expected]}


def required_columns(columns: list[str], required: tuple[str, ...], allow_extra: bool = True) -> dict[str, int]:
    """Place of each required column; raises if one is missing, or if others are there and not allowed."""
    missing = [c for c in required if c not in columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    extra = [c for c in columns if c not in required]
    if extra and not allow_extra:
        raise ValueError(f"unexpected columns: {extra}")
    return {c: columns.index(c) for c in required}
