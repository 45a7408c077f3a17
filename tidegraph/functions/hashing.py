"""Hashes of texts, events and rows."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def content_hash(c: Column, length: int = 64) -> Column:
    """The first ``length`` hexadecimal digits of the SHA-256 of a text."""
    return F.substring(F.sha2(c, 256), 1, length)


def fields_hash(*columns: Column) -> Column:
    """SHA-256 over the fields as text, each followed by a separator; NULL differs from the empty text."""
    parts = [x for c in columns for x in (F.coalesce(c.cast("string"), F.lit("\x00")), F.lit(SEPARATOR))]
    return F.sha2(F.concat(*parts), 256)


def event_signature(author: Column, time_iso: Column, text_hash: Column, relation_id: Column, target: Column) -> Column:
    """The signature of an event: SHA-256 over its five parts, each followed by a separator."""
    parts = [x for c in (author, time_iso, text_hash, relation_id, target) for x in (F.coalesce(c.cast("string"), F.lit("")), F.lit(SEPARATOR))]
    return F.sha2(F.concat(*parts), 256)


def private(prefix: str, c: Column) -> Column:
    """A value that may be shown instead of an id: the prefix and 16 digits of its hash; ``prefix:null`` for NULL."""
    return F.concat(F.lit(f"{prefix}:"), F.coalesce(content_hash(c, 16), F.lit("null")))


def file_reference(c: Column) -> Column:
    """A file's name without its folders; for absolute paths a hash and the ending."""
    name = F.regexp_extract(c, r"([^/\\]*)$", 1)
    ending = F.regexp_extract(name, r"(\.[A-Za-z0-9]+)$", 1)
    return F.when(c.rlike(r"^(?:/|[A-Za-z]:[\\/]|\\\\)"), F.concat(F.lit("file-"), content_hash(c, 12), ending)).otherwise(name)


def redact_paths_and_mail(c: Column) -> Column:
    """A message with absolute paths and mail addresses replaced."""
    paths = F.regexp_replace(c, r"(?<![\w/])(?:/[\w.\-]+){2,}/?|[A-Za-z]:\\[^\s\"']+", "[path]")
    return F.regexp_replace(paths, r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)+", "[email]")


def row_fingerprint(*columns: Column) -> Column:
    """Order-insensitive fingerprint of a set of rows: an exclusive or of their hashes."""
    return F.bit_xor(F.xxhash64(*columns))


def canonical_json(value: Any) -> str:
    """JSON with sorted keys, ASCII only and without NaN: equal values give equal text."""
    return json.dumps(value, sort_keys=True, ensure_ascii=True, allow_nan=False, separators=(",", ":"))


def canonical_hash(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def ordered_hash(lines: Iterable[str]) -> str:
    """SHA-256 over lines in the given order, each ended by a line feed."""
    h = hashlib.sha256()
    for line in lines:
        h.update(line.encode() + b"\n")
    return h.hexdigest()


def schema_signature(columns: Iterable[str], ordered: bool = False) -> str:
    """Twelve digits that stand for a list of column names, in any order or in this one; case and blanks around do not matter."""
    names = [str(c).strip().lower() for c in columns]
    return hashlib.sha256("|".join(names if ordered else sorted(names)).encode()).hexdigest()[:12]
