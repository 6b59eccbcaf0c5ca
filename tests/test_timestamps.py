from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import timestamps as T
from tallyforge.operators.timestamps import abbreviations, line_stamps, normalise_stamps, with_wall_clock, zone_history

SCHEMA = "id int, raw string, tz string, source_path string, received_at timestamp"


def us(text):
    return int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp() * 1_000_000)


CASES = [
    ("2026-03-08T09:46:56.561Z", "America/New_York", "2026-03-08T09:46:56.561", "zone"),
    ("  2026-03-08T09:46:56z ", None, "2026-03-08T09:46:56", "zone"),
    ("2026-03-08 05:00:00", "America/New_York", "2026-03-08T09:00:00", "host"),
    ("2026-03-08 01:00:00", "US/Eastern", "2026-03-08T06:00:00", "host"),
    ("2026-03-08 02:30:00", "America/New_York", None, "skipped"),
    ("2025-11-02 01:30:00", "America/New_York", None, "ambiguous"),
    ("2025-11-02 01:30:00 EST", "America/New_York", "2025-11-02T06:30:00", "zone"),
    ("2025-11-02 01:30:00 EST", "Europe/Berlin", None, "unreadable"),
    ("2025-11-02 01:30:00 UTC", "Europe/Berlin", "2025-11-02T01:30:00", "zone"),
    ("2025-10-05 02:15:00", "Australia/Lord_Howe", None, "skipped"),
    ("2025-10-26 02:30:00", "Europe/Berlin", None, "ambiguous"),
    ("2026-03-08", "Asia/Kolkata", "2026-03-07T18:30:00", "host"),
    ("08.03.2026 05:08:05", None, "2026-03-08T05:08:05", "assumed"),
    ("20251122T075426Z", None, "2025-11-22T07:54:26", "zone"),
    ("2026-01-16T03-18-06.762Z", None, "2026-01-16T03:18:06.762", "zone"),
    ("2026/03/08 12:24:05,747", None, "2026-03-08T12:24:05.747", "assumed"),
    ("Sat, 15 Aug 2026 19:20:31 +0200", "Asia/Tokyo", "2026-08-15T17:20:31", "zone"),
    ("Mar 29, 2026, 12:36:14 AM", None, "2026-03-29T00:36:14", "assumed"),
    ("Oct 21, 2025, 12:47:58 PM", "Asia/Shanghai", "2025-10-21T04:47:58", "host"),
    ("2026-08-07T08:12:54.619+02:00[Europe/Berlin]", None, "2026-08-07T06:12:54.619", "zone"),
    ("2026-08-02 14:08:20.753+00", "Asia/Tokyo", "2026-08-02T14:08:20.753", "zone"),
    ("2026-03-24 15:55:20 +05:45", None, "2026-03-24T10:10:20", "zone"),
    ("2026-03-08T06:51:49.228923989Z", None, "2026-03-08T06:51:49.228923", "zone"),
    ("1772964479", None, "2026-03-08T10:07:59", "number"),
    ("1772974516.357", "Asia/Tokyo", "2026-03-08T12:55:16.357", "number"),
    ("1772969162119", None, "2026-03-08T11:26:02.119", "number"),
    ("1777880043000001", None, "2026-05-04T07:34:03.000001", "number"),
    ("1772950693000000934", None, "2026-03-08T06:18:13", "number"),
    ("0", None, None, "unreadable"), ("-1", None, None, "unreadable"), ("", None, None, "missing"), (None, None, None, "missing"), ("n/a", None, None, "unreadable"),
    ("25:61", None, None, "unreadable"), ("2026-02-30T10:00:00Z", None, None, "unreadable"), ("2026-13-01", None, None, "unreadable"), ("0001-01-01T00:00:00Z", None, None, "unreadable"),
    ("2026-03-08 05:00:00", "Mars/Base", None, "unreadable"), ("9" * 5000, None, None, "unreadable"), ("2024-12-31T23:59:59Z", None, None, "unreadable"),
]


def test_cases(spark):
    rows = [(i, c[0], c[1], "p", None) for i, c in enumerate(CASES)] * 2
    out = normalise_stamps(spark.createDataFrame(rows, SCHEMA), "raw", "tz").collect()
    assert len(out) == len(rows)
    for r in out:
        raw, _, want, note = CASES[r.id]
        tz = CASES[r.id][1]
        if tz == "Mars/Base":
            assert r.utc_us is None
            continue
        assert (r.utc_us, r.stamp_note) == (us(want) if want else None, note), (raw, tz)


def test_clashing_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "2026-03-08T00:00:00Z", None, "p", None)], SCHEMA).withColumn("_raw", F.lit(1)).withColumn("_mark", F.lit("m")).withColumn("utc_us", F.lit(5))
    out = normalise_stamps(df, "raw", "tz")
    r = out.collect()[0]
    assert r.utc_us == us("2026-03-08") and r._raw == 1 and r._mark == "m"
    assert normalise_stamps(spark.createDataFrame([], SCHEMA), "raw", "tz").count() == 0


def test_member_is_top_level(spark):
    body = '{"type": "say", "text": "{\\"ts\\": 9}", "nested": {"timestamp": "x"}, "createdAt": 1772950693000000934}'
    df = spark.createDataFrame([(1, "p", None, None, body), (2, "p", None, None, "{broken"), (3, "p", None, None, None)], "record_id bigint, source_path string, host_tz string, received_at timestamp, body string")
    assert {r.record_id: r.raw for r in line_stamps(df).collect()} == {1: "1772950693000000934", 2: None, 3: None}


def test_zone_history_and_estimate(spark):
    rows = []
    for d in range(1, 6):
        for k in range(6):
            off = 1 if d < 4 else 2  # the source changes its offset on the fourth day
            rows.append((len(rows), f"2026-03-0{d} {12 + off}:{10 + k}:00", None, "src", datetime(2026, 3, d, 12, 10 + k, 5)))
        rows.append((len(rows), f"2026-03-0{d} 05:00:00", None, "src", datetime(2026, 3, d, 12, 0, 0)))  # late
    df = spark.createDataFrame(rows, SCHEMA)
    hist = {r.day.day: r.offset_s for r in zone_history(with_wall_clock(df, "raw", "local"), "source_path", "received_at", "local").collect()}
    assert hist == {1: 3600, 2: 3600, 3: 3600, 4: 7200, 5: 7200}
    out = normalise_stamps(df, "raw", "tz", unknown_zone="estimate").where("id = 0").collect()[0]
    assert out.utc_us == us("2026-03-01T12:10:00") and out.stamp_note == "assumed"


def test_zone_history_keeps_very_late_lines(spark):
    rows = []
    for d in (1, 2, 4):
        rows += [(len(rows) + k, f"2026-03-0{d} 13:1{k}:00", None, "src", datetime(2026, 3, d, 12, 10 + k, 5)) for k in range(5)]
    rows += [(90, "2026-02-27 05:00:00", None, "src", datetime(2026, 3, 2, 12)), (91, "2026-03-01 05:00:00", None, "src", datetime(2026, 3, 3, 12)),
             (92, "2026-03-01 05:00:00", None, "lost", datetime(2026, 3, 3, 12))]
    df = spark.createDataFrame(rows, SCHEMA)
    hist = {(r.source, r.day.day): (r.offset_s, r.lines, r.violations) for r in zone_history(with_wall_clock(df, "raw", "local"), "source_path", "received_at", "local").collect()}
    assert hist == {("src", 1): (3600, 5, 0), ("src", 2): (3600, 6, 1), ("src", 3): (3600, 1, 1), ("src", 4): (3600, 5, 0), ("lost", 3): (None, 1, 1)}
    out = {r.id: r.utc_us for r in normalise_stamps(df, "raw", "tz", unknown_zone="estimate").where("id in (91, 92)").collect()}
    assert out == {91: us("2026-03-01T04:00:00"), 92: us("2026-03-01T05:00:00")}


def test_abbreviations_are_made_from_the_database():
    table = {(z, a): o for z, a, o in abbreviations(["America/New_York", "Europe/Berlin", "No/Where"])}
    assert table == {("America/New_York", "EST"): -18000, ("America/New_York", "EDT"): -14400, ("Europe/Berlin", "CET"): 3600, ("Europe/Berlin", "CEST"): 7200}


@pytest.mark.parametrize("unknown", ["utc", "estimate"])
def test_null_everything(spark, unknown):
    df = spark.createDataFrame([(None, None, None, None, None)], SCHEMA)
    assert normalise_stamps(df, "raw", "tz", unknown_zone=unknown).collect()[0].utc_us is None


def test_sequence_tells_the_offset_of_late_lines(spark):
    """Zone-less lines of a machine two hours ahead that all arrive days late, between lines with zones."""
    rows = []
    for i in range(12):
        utc = datetime(2026, 3, 1, 10, i)
        raw = utc.strftime("%Y-%m-%dT%H:%M:%SZ") if i % 3 == 0 else (utc + timedelta(hours=2)).strftime("%Y-%m-%d %H:%M:%S")
        rows.append((i, "f", utc + timedelta(days=2, hours=i), raw, None))
    df = spark.createDataFrame(rows, "line_no int, source_path string, received_at timestamp, raw string, host_tz string")
    got = {r.line_no: r.utc_us for r in T.normalise_stamps(df, "raw", "host_tz", unknown_zone="estimate", order=["line_no"]).collect()}
    want = {i: int((datetime(2026, 3, 1, 10, i) - datetime(1970, 1, 1)).total_seconds()) * 1_000_000 for i in range(12)}
    assert {k: v for k, v in got.items() if k < 10} == {k: v for k, v in want.items() if k < 10}
    acc = T.zone_accuracy(df.withColumn("host_tz", F.lit("Etc/GMT-2")), "host_tz", "raw", "host_tz", "received_at", "source_path", ["line_no"]).collect()
    assert [(r.source, r.lines) for r in acc] == [("Etc/GMT-2", 8)] and acc[0].right_lines >= 6


def test_long_numbers(spark):
    rows = [("1767225600" + "." + "0" * 60 + "1",), ("0" * 50 + "1767225600",), ("1" * 60,), ("-" + "9" * 50,)]
    got = [r.utc_us for r in T.normalise_stamps(spark.createDataFrame(rows, "raw string").withColumn("z", F.lit(None).cast("string")), "raw", "z").collect()]
    assert got == [1767225600_000_000, 1767225600_000_000, None, None]
