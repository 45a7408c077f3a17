"""Text functions; all but ``normalized_text`` stay inside the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.session import ship

#: Class of white space as Unicode has it, plus the four separators that \s leaves out.
SPACE = r"[\s\x1c-\x1f]"
#: Decimal digits of the scripts met in social posts, in the order 0-9 (fixed values).
DIGITS = (
    "٠١٢٣٤٥٦٧٨٩"
    "۰۱۲۳۴۵۶۷۸۹"
    "०१२३४५६७८९"
    "০১২৩৪৫৬৭৮৯"
    "๐๑๒๓๔๕๖๗๘๙"
    "０１２３４５６７８９"
)


def strip(c: Column) -> Column:
    """Without white space at either end, U+00A0 and other Unicode spaces included."""
    # the look-behind keeps long inner runs from being tried from each of their places
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|(?<!{SPACE}){SPACE}+$", "")


def ascii_digits(c: Column) -> Column:
    """Decimal digits of other scripts written as 0-9; everything else stays."""
    return F.translate(c, DIGITS, "0123456789" * (len(DIGITS) // 10))


def plain_status(c: Column) -> Column:
    """A status in its plain spelling: case and white space around do not matter, blank means none."""
    return F.nullif(F.lower(strip(c)), F.lit(""))


def is_blank(c: Column) -> Column:
    """NULL, empty or only white space."""
    return c.isNull() | c.rlike(rf"(?U)^{SPACE}*$")


def words(c: Column) -> Column:
    """Maximal runs of letters or digits (Unicode L or N) in text order, each lower-cased.

    The runs are cut before lower-casing, so a letter whose lower case has a
    combining mark stays one word. NULL and texts without words give an empty array.
    """
    spaced = F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}]+", " ")))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def plain_line_ends(c: Column) -> Column:
    """Without byte order marks, all line ends as line feeds."""
    return F.regexp_replace(F.regexp_replace(c, "﻿", ""), "\r\n?", "\n")


def normalized_text(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with ``out``: the text without byte order marks, with line feeds and composed letters (NFC).

    Spark has no Unicode normalisation; texts are composed in Arrow batches.
    """
    ship(df.sparkSession)

    @F.arrow_udf("string")
    def composed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([t if t is None or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t) for t in batch.to_pylist()], pa.string())

    return df.withColumn(out, composed(plain_line_ends(F.col(column))))
