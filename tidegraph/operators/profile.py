"""Profiles of tables whose columns are not known yet."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.times import profile_epoch

# The roles of columns and the patterns by which a name shows them.
ROLES = {
    "tweet_id": (r"^id$", r"tweet.?id", r"status.?id", r"post.?id"),
    "author_account_id": (r"user.?id", r"author.?id", r"account.?id", r"^uid$"),
    "author_user_blob": (r"^user$", r"^author$"),
    "username": (r"user.?name", r"screen.?name", r"handle"),
    "timestamp": (r"created.?at", r"^timestamp$", r"^time$", r"^date$"),
    "text": (r"^text$", r"full.?text", r"content", r"body", r"^ocr_text$"),
    "reply": (r"reply", r"in.?reply.?to"),
    "retweet": (r"retweet", r"^rt$", r"retweeted.?status"),
    "quote": (r"quote", r"quoted.?status", r"is.?quote"),
    "mention": (r"mention", r"user.?mentions"),
    "language": (r"^lang$", r"language", r"text.?lang"),
}


def column_roles(columns: list[str]) -> dict[str, list[str]]:
    """The columns by role, in their order; one column may have several, case and blanks around do not matter."""
    return {role: [c for c in columns if any(re.search(p, c.strip().lower()) for p in patterns)] for role, patterns in ROLES.items()}


def role_table(names: DataFrame, column: str) -> DataFrame:
    """``column`` and role, one row for each role a name has."""
    low = F.lower(F.trim(F.col(column)))
    shown = F.array_compact(F.array(*[F.when(low.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(role)) for role, patterns in ROLES.items()]))
    return names.select(column, F.explode(shown).alias("role"))


def value_type(c: Column) -> Column:
    """What a cell's text looks like: null, integer, float, boolean, date, object, list or string."""
    s = F.trim(c.cast("string"))
    return (
        F.when(s.isNull() | (s == ""), "null")
        .when(s.rlike(r"^[+-]?\d+$"), "integer")
        .when(s.rlike(r"^[+-]?(?:\d+\.\d*|\.\d+|\d+(?:\.\d*)?[eE][+-]?\d+)$"), "float")
        .when(F.lower(s).isin("true", "false"), "boolean")
        .when(s.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?.*)?$"), "date")
        .when(s.rlike(r"(?s)^\{.*\}$"), "object")
        .when(s.rlike(r"(?s)^\[.*\]$"), "list")
        .otherwise("string")
    )


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: rows, nulls, distinct values and the share of the commonest type.

    Cells become (column, value) rows that are counted before they are shuffled twice, so wide
    and skewed tables need no state per column in one task.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns]))
    counted = df.select(cells.alias("c")).select("c.*").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    typed = counted.groupBy("column", value_type(F.col("value")).alias("type")).agg(F.sum("n").alias("n"), F.count("value").alias("distinct"))
    best = F.min(F.when(F.col("type") != "null", F.struct((-F.col("n")).alias("n"), "type")))
    return typed.groupBy("column").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("type") == "null", F.col("n")).otherwise(0)).alias("nulls"), F.sum(F.when(F.col("type") == "null", 0).otherwise(F.col("distinct"))).alias("distinct_values"), best["type"].alias("type")
    )


def key_profile(df: DataFrame, key: str, user: str, time: str) -> DataFrame:
    """One row: rows, distinct keys, rows beyond the first of their key, distinct users, usable and invalid times, first and last."""
    keys = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("distinct_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))
    users = df.where(F.col(user).isNotNull()).select(user).distinct().agg(F.count(F.lit(1)).alias("distinct_users"))
    t = profile_epoch(F.col(time))
    rest = df.agg(F.count(F.lit(1)).alias("rows"), F.count(t).alias("valid_times"), F.count_if(F.col(time).isNotNull() & t.isNull()).alias("invalid_times"), F.min(t).alias("first_epoch"), F.max(t).alias("last_epoch"))
    return rest.select(
        "rows", keys.select("distinct_keys").scalar().alias("distinct_keys"), keys.select("duplicate_rows").scalar().alias("duplicate_rows"), users.scalar().alias("distinct_users"), "valid_times", "invalid_times", "first_epoch", "last_epoch"
    )


def download_verdict(head: Column, size: Column, expected: Column) -> Column:
    """empty, html_page, size_mismatch, not_xlsx or ok, from the first bytes and the size of a file."""
    text = F.lower(F.decode(F.substring(head, 1, 512), "ISO-8859-1"))
    return (
        F.when(F.coalesce(size, F.lit(0)) == 0, "empty").when(text.rlike(r"^\s*(?:<!doctype html|<html|<head|<script)"), "html_page").when(expected.isNotNull() & (expected != size), "size_mismatch").when(~text.startswith("pk"), "not_xlsx").otherwise("ok")
    )
