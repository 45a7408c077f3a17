from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidegraph.operators.timestamps import normalise_timestamps

CASES = [
    # raw, zone of the file, outcome
    ("2018-03-01T12:00:00+00:00", "Europe/Berlin", "2018-03-01T12:00:00.000000Z"),
    ("2018-03-01 12:00:00", "Europe/Berlin", "2018-03-01T11:00:00.000000Z"),
    ("2018-07-01 12:00:00", "Europe/Berlin", "2018-07-01T10:00:00.000000Z"),
    ("2018-03-01 12:00:00", None, "2018-03-01T12:00:00.000000Z"),
    ("2018-03-01 12:00:00", "UTC+9", "2018-03-01T03:00:00.000000Z"),
    ("2018-03-01 12:00:00", "GMT-5", "2018-03-01T17:00:00.000000Z"),
    ("2018-03-01 12:00:00", "+03:30", "2018-03-01T08:30:00.000000Z"),
    ("2018-03-01 12:00:00", "utc", "2018-03-01T12:00:00.000000Z"),
    ("2018-03-01 12:00:00", "Nowhere/Land", "invalid_timestamp"),
    ("2018-03-01 12:00:00 KST", "Europe/Berlin", "2018-03-01T03:00:00.000000Z"),
    ("2018-03-01 12:00:00 CEST", None, "2018-03-01T10:00:00.000000Z"),
    ("2018-03-01 12:00:00 XYZ", None, "invalid_timestamp"),
    ("2026-03-29T02:11:06", "Europe/Berlin", "2026-03-29T01:11:06.000000Z"),  # skipped: moves forward
    ("2025-10-26 02:47:56", "Europe/Berlin", "2025-10-26T00:47:56.000000Z"),  # repeated: first pass
    ("22.03.2018 00:51", None, "2018-03-22T00:51:00.000000Z"),
    ("03/13/2018 3:24 PM", None, "2018-03-13T15:24:00.000000Z"),
    ("11/27/2017 12:21 AM", None, "2017-11-27T00:21:00.000000Z"),
    ("13/27/2017 12:21 AM", None, "invalid_timestamp"),
    ("11/27/2017 13:21 AM", None, "invalid_timestamp"),
    ("2017/11/27 08:01:38", None, "2017-11-27T08:01:38.000000Z"),
    ("Tue Dec 05 18:52:39 +0900 2017", None, "2017-12-05T09:52:39.000000Z"),
    ("Sat, 14 Apr 2018 07:14:27 +0430", None, "2018-04-14T02:44:27.000000Z"),
    ("20 November 2017, 09:20", None, "2017-11-20T09:20:00.000000Z"),
    ("20171011T183033Z", "Asia/Seoul", "2017-10-11T18:30:33.000000Z"),
    ("2017-10-19", "Asia/Seoul", "2017-10-18T15:00:00.000000Z"),
    ("2017-11-04T22:07:51.594Z", None, "2017-11-04T22:07:51.594000Z"),
    ("2017-11-21T05:02:59.028017+00:00", None, "2017-11-21T05:02:59.028017Z"),
    ("1517643788", "Asia/Seoul", "2018-02-03T07:43:08.000000Z"),
    ("1517643788123", None, "2018-02-03T07:43:08.123000Z"),
    ("1517643788123456", None, "2018-02-03T07:43:08.123456Z"),
    ("1517258944.5", None, "2018-01-29T20:49:04.500000Z"),
    ("۱۵۱۷۶۴۳۷۸۸", None, "2018-02-03T07:43:08.000000Z"),
    ("\u00a02017-10-19T00:00:00Z ", None, "2017-10-19T00:00:00.000000Z"),
    ("2019-02-30 10:00:00", None, "invalid_timestamp"),
    ("2020-05-01T25:10:00+00:00", None, "invalid_timestamp"),
    ("2020-05-01T24:00:00+00:00", None, "invalid_timestamp"),
    ("2020-05-01T10:00:60+00:00", None, "invalid_timestamp"),
    ("2006-03-20T23:59:59+00:00", None, "invalid_timestamp"),
    ("2006-03-21T00:00:00+00:00", None, "2006-03-21T00:00:00.000000Z"),
    ("2026-06-30T23:59:59+00:00", None, "2026-06-30T23:59:59.000000Z"),
    ("2026-07-01T00:00:00+00:00", None, "invalid_timestamp"),
    ("2018-Q3", None, "invalid_timestamp"),
    ("0", None, "invalid_timestamp"),
    ("-1", None, "invalid_timestamp"),
    ("inf", None, "invalid_timestamp"),
    ("", None, "invalid_timestamp"),
    ("  ", None, "invalid_timestamp"),
    (None, None, "invalid_timestamp"),
    ("9" * 400, None, "invalid_timestamp"),
    ("x" * 100_000, None, "invalid_timestamp"),
]


def frames(spark, rows, extra=""):
    files = {z: f"f{i}" for i, z in enumerate(sorted({z for _, z, _ in rows}, key=str))}
    e = spark.createDataFrame([(i, files[z], raw, "mine") for i, (raw, z, _) in enumerate(rows)], "event_id bigint, source_file string, created_at_utc_iso string, outcome string")
    s = spark.createDataFrame([(f, z) for z, f in files.items()], "source_file string, timezone_assumption string")
    return e, s


def test_cases(spark):
    e, s = frames(spark, CASES)
    got = {r.event_id: r for r in normalise_timestamps(e, s).collect()}
    assert len(got) == len(CASES)
    for i, (raw, zone, want) in enumerate(CASES):
        assert got[i].outcome == want, (raw, zone)
    assert got[0].already_normal and not got[1].already_normal and not got[2].already_normal


def test_other_session_zone_gives_the_same(spark):
    e, s = frames(spark, CASES)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = {r.event_id: r.outcome for r in normalise_timestamps(e, s).select("event_id", "outcome").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [got[i] for i in range(len(CASES))] == [w for _, _, w in CASES]


def test_clashing_names_and_unknown_file(spark):
    e = spark.createDataFrame([(1, "none", "2018-03-01 12:00:00", "a", "b", 3)], "event_id bigint, source_file string, created_at_utc_iso string, _s string, _zone string, instant_utc int")
    s = spark.createDataFrame([], "source_file string, timezone_assumption string")
    r = normalise_timestamps(e, s).first()
    assert (r._s, r._zone, r.outcome, str(r.instant_utc)) == ("a", "b", "2018-03-01T12:00:00.000000Z", "2018-03-01 12:00:00")
    assert normalise_timestamps(e.limit(0), s).count() == 0


def test_against_python(spark, data):
    """Offsets, dots and epoch numbers of the whole table, by a plain reading in Python."""
    e = spark.read.parquet(f"{data}/graph_events.parquet")
    s = spark.read.parquet(f"{data}/calendar_sources.parquet")
    got = normalise_timestamps(e, s).select("created_at_utc_iso", "outcome").where(F.col("created_at_utc_iso").rlike(r"^\d{10}$|^\d{4}-\d\d-\d\dT[\d:]{8}[+-]\d\d:\d\d$")).collect()
    assert len(got) > 100
    for raw, outcome in got:
        try:
            t = datetime.fromtimestamp(int(raw), timezone.utc) if raw.isdigit() else datetime.fromisoformat(raw).astimezone(timezone.utc)
        except ValueError:
            t = None
        ok = t is not None and datetime(2006, 3, 21, tzinfo=timezone.utc) <= t < datetime(2026, 6, 30, tzinfo=timezone.utc) + timedelta(days=1)
        assert outcome == (t.strftime("%Y-%m-%dT%H:%M:%S.000000Z") if ok else "invalid_timestamp"), raw


@pytest.mark.parametrize("zone", ["UTC", "Z", "GMT", "+00:00", " utc "])
def test_notations_of_utc(spark, zone):
    e, s = frames(spark, [("2018-03-01 12:00:00", zone, "")])
    assert normalise_timestamps(e, s).first().outcome == "2018-03-01T12:00:00.000000Z"
