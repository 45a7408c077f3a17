"""Account and post ids, and the user objects they are written in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegraph.functions.text import strip

_NOTHING = ("", "none", "null", "nan")
_ID = r"['\"]id['\"]\s*:\s*['\"]?(\d+)"


def account_id(c: Column) -> Column:
    """Digits of an account id; NULL for anything else, fractions included."""
    s = strip(c.cast("string"))
    return F.when(s.rlike(r"^\d+$"), s)


def tweet_id_error(c: Column) -> Column:
    """NULL for a post id of 15 to 20 digits, else invalid_tweet_id_float or invalid_tweet_id."""
    s = F.coalesce(strip(c.cast("string")), F.lit(""))
    floating = s.rlike(r"^[+-]?\d+(?:\.\d*)?(?:[eE][+-]?\d+)?$") & s.rlike(r"[.eE]")
    return F.when(floating, "invalid_tweet_id_float").when(~s.rlike(r"^\d{15,20}$"), "invalid_tweet_id")


def tweet_id(c: Column) -> Column:
    """The post id as a string of digits, NULL if it is none."""
    return F.when(tweet_id_error(c).isNull(), strip(c.cast("string")))


def literal_as_json(c: Column) -> Column:
    """A Python literal of plain objects, as far as ids go, in JSON: None, True and False replaced."""
    s = F.regexp_replace(c, r"\bNone\b", "null")
    return F.regexp_replace(F.regexp_replace(s, r"\bTrue\b", "true"), r"\bFalse\b", "false")


def blank_object(c: Column) -> Column:
    s = F.lower(strip(c))
    return s.isNull() | s.isin(*_NOTHING)


def user_object(c: Column) -> Column:
    """account_id, username, ok and error of a user object in JSON or as a Python literal.

    missing_user for nothing, user_not_object for other JSON, missing_user_id without
    an id or with a fractional one, malformed_user_blob for what cannot be read; an id that
    can be found in an unreadable text is used with error recovered_by_regex.
    """
    parsed = F.from_json(literal_as_json(c), "id string, username string", {"allowSingleQuotes": "true"})
    found = F.regexp_extract(c, _ID, 1)
    whole = parsed["id"].rlike(r"^\d+$")
    fraction = c.rlike(r"['\"]id['\"]\s*:\s*\d+\.\d")
    readable = strip(c).rlike(r"(?s)^\{.*\}$") & F.coalesce(parsed["id"].isNotNull() | parsed["username"].isNotNull() | c.rlike(r"^\s*\{\s*\}\s*$"), F.lit(False))
    other = strip(c).rlike(r"^(?:\[.*\]|\"[^\"]*\"|'[^']*'|[+-]?\d+(?:\.\d+)?|true|false|True|False)$")
    result = lambda i, u, ok, e: F.struct(i.alias("account_id"), u.alias("username"), F.lit(ok).alias("ok"), F.lit(e).cast("string").alias("error"))
    none = F.lit(None).cast("string")
    return (
        F.when(blank_object(c), result(none, none, False, "missing_user"))
        .when(readable & whole & ~fraction, result(parsed["id"], parsed["username"], True, None))
        .when(other, result(none, none, False, "user_not_object"))
        .when(readable | fraction, result(none, none, False, "missing_user_id"))
        .when(found != "", result(found, none, True, "recovered_by_regex"))
        .otherwise(result(none, none, False, "malformed_user_blob"))
    )


def nested_user_id(c: Column, any_id: bool = True) -> Column:
    """The id of the user inside a status object; with ``any_id`` the first id of any kind where there is no user."""
    inside = F.regexp_extract(c, r"(?s)['\"]user['\"]\s*:\s*[\"']?\{[^{}]*?" + _ID, 1)
    first = F.regexp_extract(c, _ID, 1)
    return F.when(blank_object(c), None).otherwise(F.coalesce(F.nullif(inside, F.lit("")), F.nullif(first, F.lit("")) if any_id else F.lit(None)))


def mention_ids(c: Column) -> Column:
    """All ids of a list of mentions: objects with an id, or bare numbers and strings of digits."""
    objects = F.regexp_extract_all(c, F.lit(_ID), F.lit(1))
    bare = F.regexp_extract_all(c, F.lit(r"(?<![\w.])['\"]?(\d+)['\"]?(?=\s*[,\]])"), F.lit(1))
    return F.when(blank_object(c), F.array().cast("array<string>")).when(c.contains("{"), objects).otherwise(bare)
