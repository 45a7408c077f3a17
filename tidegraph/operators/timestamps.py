"""Mixed timestamp formats and zones to one UTC instant (problem 6).

An ordered cascade of anchored patterns rewrites a text to
``year|month|day|hour|minute|second|fraction|half|zone``; the fields are then
checked strictly (no day 31 in June, no second 60, no hour 24). Everything is a
column expression, so the cascade runs inside the scan stage.

Local times follow a fixed policy: one that a clock change skips moves forward
by the length of the gap, one that occurs twice means the first pass.
"""

from __future__ import annotations

from functools import reduce
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.frames import carry, restore
from tidegraph.functions.text import ascii_digits, strip

FIRST_INSTANT = "2006-03-21 00:00:00"
LAST_INSTANT = "2026-06-30 23:59:59.999999"

#: Zone letters with the offset each stands for (fixed values).
ZONE_LETTERS = {
    "Z": "+00:00",
    "UTC": "+00:00",
    "GMT": "+00:00",
    "CET": "+01:00",
    "CEST": "+02:00",
    "KST": "+09:00",
    "EST": "-05:00",
    "EDT": "-04:00",
    "PST": "-08:00",
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

#: Area names of the zone database, so that an unknown name is no error but no zone.
AREAS = tuple(sorted(x for x in available_timezones() if "/" in x and not x.startswith(("posix/", "right/"))))

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_ZONE = r"(?: ?([A-Za-z]{1,5}|[+-]\d{2}(?::?\d{2})?))?"
#: Name, pattern and the field order of its groups; the first pattern that fits decides.
CASCADE = (
    ("year_first_dashes", rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:[Tt ]{_TIME}{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    ("compact", r"^(\d{4})(\d{2})(\d{2})[Tt](\d{2})(\d{2})(?:(\d{2})(?:[.,](\d{1,9}))?)?" + _ZONE + "$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    ("year_first_slashes", rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}})(?: {_TIME}{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    ("day_first_dots", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:,? {_TIME}{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    ("month_first_half_day", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),? {_TIME} ?([AaPp])\.?[Mm]\.?{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    ("weekday_month_day", rf"^[A-Za-z]{{3}},? ([A-Za-z]{{3}}) (\d{{1,2}}) {_TIME}{_ZONE} (\d{{4}})$", "$8|$1|$2|$3|$4|$5|$6||$7"),
    ("day_month_name", rf"^(?:[A-Za-z]{{3}}, )?(\d{{1,2}}) ([A-Za-z]{{3,9}}) (\d{{4}})(?:,? {_TIME}{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7||$8"),
)
_NUMBER = r"^[+-]?\d{1,17}(?:\.\d{0,9})?(?:[eE]\+?\d{1,2})?$"


def _month_number(c: Column) -> Column:
    """A month as number or as English name, short or full."""
    full = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
    low = F.lower(c)
    named = reduce(lambda e, m: e.when(low.isin(MONTHS[m], full[m]), F.lit(m + 1)), range(12), F.when(low == "sept", F.lit(9)))
    return F.coalesce(F.when(c.rlike(r"^\d+$"), c.try_cast("int")), named)


def zone_name(c: Column) -> Column:
    """A zone as written in a timestamp: an offset, a fixed letter code, '' for none, NULL if unknown."""
    up = F.upper(c)
    letters = reduce(lambda e, z: e.when(up == z, F.lit(ZONE_LETTERS[z])), ZONE_LETTERS, F.when(c == "", F.lit("")))
    digits = F.rpad(F.regexp_replace(c, "[^0-9]", ""), 4, "0")
    good = (F.substring(digits, 1, 2) <= "18") & (F.substring(digits, 3, 2) < "60")
    offset = F.when(good, F.concat(F.substring(c, 1, 1), F.substring(digits, 1, 2), F.lit(":"), F.substring(digits, 3, 2)))
    return F.when(c.rlike(r"^[+-]"), offset).otherwise(letters)


def default_zone(c: Column) -> Column:
    """A file's assumed zone in any of its notations: NULL and blank mean UTC.

    'UTC', 'utc', 'Z', '+03:30', 'UTC+9' and 'GMT-5' become offsets, area names
    like 'Europe/Berlin' stay. Anything else is NULL: it names no zone.
    """
    s = strip(c)
    shifted = F.regexp_extract(s, r"^(?i)(?:UTC|GMT)?([+-]\d{1,2}(?::?\d{2})?)$", 1)
    hours = F.regexp_extract(shifted, r"^[+-](\d{1,2})", 1)
    minutes = F.regexp_extract(shifted, r"(\d{2})$", 1)
    minutes = F.when(F.length(F.regexp_replace(shifted, "[^0-9]", "")) > 2, minutes).otherwise(F.lit("00"))
    digits = F.regexp_replace(shifted, "[^0-9]", "")
    hours = F.when(F.length(digits) == 4, F.substring(digits, 1, 2)).when(F.length(digits) == 3, F.substring(digits, 1, 1)).otherwise(hours)
    return (
        F.when(s.isNull() | (s == "") | F.upper(s).isin("UTC", "GMT", "Z"), F.lit("+00:00"))
        .when(shifted != "", F.concat(F.substring(shifted, 1, 1), F.lpad(hours, 2, "0"), F.lit(":"), minutes))
        .when(s.isin(*AREAS) if AREAS else s.rlike(r"^[A-Za-z]+(?:/[A-Za-z_+\-0-9]+)+$"), s)
    )


def with_instant(df: DataFrame, column: str, zone: str) -> DataFrame:
    """``df`` plus ``instant_utc``: the instant of ``column`` as TIMESTAMP_NTZ in UTC, or NULL.

    ``zone`` is the column with the zone of times that name none. The steps are
    separate projections, so that each text is matched and split only once.
    """
    s, f = F.col("_s"), F.col("_f")
    rewritten = reduce(lambda e, p: e.when(s.rlike(p[1]), F.regexp_replace(s, p[1], p[2])), CASCADE[1:], F.when(s.rlike(CASCADE[0][1]), F.regexp_replace(s, CASCADE[0][1], CASCADE[0][2])))
    at = lambda i: F.get(f, F.lit(i))
    number = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("0")).try_cast("int")
    half = F.upper(at(7))
    hour = number(at(3))
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "P", F.lit(12)).otherwise(F.lit(0)))
    second = F.when(number(at(5)) < 60, F.concat(number(at(5)).cast("string"), F.lit("."), F.rpad(F.substring(at(6), 1, 6), 6, "0")).cast("decimal(16,6)"))
    local = F.call_function("try_make_timestamp_ntz", number(at(0)), _month_number(at(1)), number(at(2)), hour, number(at(4)), second)
    named = F.col("_named")
    used = F.when(named == "", F.col(zone)).otherwise(named)

    number_text = F.when(s.rlike(_NUMBER), s)
    value = number_text.try_cast("double")
    scale = F.when(F.abs(value) < 1e11, F.lit(1_000_000)).when(F.abs(value) < 1e14, F.lit(1_000)).when(F.abs(value) < 1e17, F.lit(1))
    micros = F.floor(F.coalesce(number_text.try_cast("decimal(28,9)"), value.try_cast("decimal(28,9)")) * scale).try_cast("bigint")
    epoch = F.timestamp_micros(F.col("_micros"))
    spelled = F.when(F.col("_zone") == "+00:00", F.col("_local")).otherwise(F.convert_timezone(F.col("_zone"), F.lit("UTC"), F.col("_local")))
    counted = F.convert_timezone(F.current_timezone(), F.lit("UTC"), epoch.cast("timestamp_ntz"))
    found = F.when(F.col("_micros").isNotNull(), counted).otherwise(spelled)
    low, high = (F.lit(x).cast("timestamp_ntz") for x in (FIRST_INSTANT, LAST_INSTANT))
    return (
        df.withColumn("_s", strip(ascii_digits(F.col(column))))
        .withColumns({"_f": F.split(rewritten, r"\|"), "_micros": micros})
        .withColumns({"_local": local, "_named": zone_name(at(8))})
        .withColumn("_zone", used)
        .withColumn("_found", found)
        .withColumn("instant_utc", F.when(F.col("_found").between(low, high), F.col("_found")))
        .drop("_s", "_f", "_micros", "_local", "_named", "_zone", "_found")
    )


def instant_text(c: Column) -> Column:
    """A TIMESTAMP_NTZ as YYYY-MM-DDTHH:MM:SS.ffffffZ, whatever the session's zone."""
    s = c.cast("string")
    return F.concat(F.substring(s, 1, 10), F.lit("T"), F.substring(s, 12, 8), F.lit("."), F.rpad(F.substring(s, 21, 6), 6, "0"), F.lit("Z"))


def normalise_timestamps(events: DataFrame, sources: DataFrame, column: str = "created_at_utc_iso") -> DataFrame:
    """``events`` plus ``instant_utc`` (TIMESTAMP_NTZ), ``outcome`` and ``already_normal``.

    ``sources`` gives one ``timezone_assumption`` per ``source_file``; files it
    does not name are taken as UTC, of repeated names the smallest assumption
    holds. A zone-less time in a file whose assumption names no zone is invalid.
    NULL, blank and unreadable values are invalid. Other columns pass through, save those
    with the names of the three made ones, which are replaced. The lookup is one row per
    file; Spark broadcasts it when it is small and sorts otherwise.
    """
    zones = (
        sources.groupBy("source_file")
        .agg(F.min("timezone_assumption").alias("assumed"))
        .select(F.col("source_file").alias("_file"), default_zone(F.col("assumed")).alias("_file_zone"), F.lit(True).alias("_known"))
    )
    joined = carry(events, _raw=F.col(f"`{column}`").cast("string"), _file="source_file").join(zones, "_file", "left")
    joined = joined.withColumn("_file_zone", F.when(F.col("_known"), F.col("_file_zone")).otherwise(F.lit("+00:00")))
    parsed = with_instant(joined, "_raw", "_file_zone")
    valid = F.col("instant_utc").isNotNull()
    canonical = F.coalesce(F.col("_raw").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\+00:00$"), F.lit(False))
    outcome = F.when(valid, instant_text(F.col("instant_utc"))).otherwise(F.lit("invalid_timestamp"))
    # A generator of one row keeps later filters on these columns above it; pushed down, they would
    # be written out once per use of every step of the cascade.
    made = F.explode(F.array(F.struct("instant_utc", outcome.alias("outcome"), (valid & canonical).alias("already_normal"))))
    return restore(parsed.select("_row", made.alias("_made")).select("_row", "_made.*"), events, "instant_utc", "outcome", "already_normal")
