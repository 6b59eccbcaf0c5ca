"""Problem 3: timestamps in mixed notations, precisions and zones, to UTC microseconds.

Everything is JVM-side: one regular expression per notation rewrites the text to the fields
``year|month|day|hour|minute|second|fraction|am-pm|zone``, the zone comes from the value itself, or
from the machine that wrote it. A wall-clock reading is checked against both offsets in force around
it, so readings that occur twice or never are recognised as such.

``zone_history`` and ``clock_history`` are the estimators of the method named for this problem: they align zone-less local
stamps with their arrival times (the latter also with their place between lines whose instants are known) and choose, per
source, the history of offsets with the fewest violations. ``normalise_stamps(unknown_zone="estimate")`` converts with
it the stamps whose zone nobody states.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from datetime import datetime, timezone
from zoneinfo import ZoneInfo, available_timezones

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.ordered import carried
from tallyforge.runtime import blank_to_null, cut, fresh, staged

# fixed values: month names by their first three letters
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
# fixed values: marks that mean UTC wherever they are written
_UTC_MARKS = ("Z", "UTC", "GMT", "UT")
_US = 1_000_000
_DAY_US = 86_400 * _US

_CLOCK = r"(\d{1,2})[:-](\d{2})(?:[:-](\d{2})(?:[.,](\d+))?)?"
_ZONE = r"\s*((?:[zZ]|[+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Za-z]{2,5})?(?:\s*\[[^\]]+\])?)"
_NOTATIONS = (
    (rf"^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})(?:[Tt]|\s+){_CLOCK}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})$", "$1|$2|$3|0|0|0|||"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d+))?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (r"^(\d{4})(\d{2})(\d{2})$", "$1|$2|$3|0|0|0|||"),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),?\s+{_CLOCK}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", "$3|$2|$1|0|0|0|||"),
    (rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})[ -]([A-Za-z]{{3,9}})[ -](\d{{4}}),?\s+{_CLOCK}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    (rf"^(?:[A-Za-z]{{3,9}},\s+)?([A-Za-z]{{3,9}})\.?\s+(\d{{1,2}}),?\s+(\d{{4}}),?\s+{_CLOCK}\s*([AaPp])\.?[Mm]\.?{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    (rf"^(?:[A-Za-z]{{3,9}},\s+)?([A-Za-z]{{3,9}})\.?\s+(\d{{1,2}}),?\s+(\d{{4}}),?\s+{_CLOCK}{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7||$8"),
)
_NUMBER = r"^[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$"


def abbreviations(zones: Iterable[str] | None = None, years: tuple[int, int] = (2025, 2027)) -> list[tuple[str, str, int]]:
    """(zone, abbreviation, offset in seconds) for every zone and letter abbreviation in use in those years.

    Made from the time zone database by asking every zone for its name in the middle of each month; an
    abbreviation that stood for two offsets in the span is left out.
    """
    found: dict[tuple[str, str], set[int]] = {}
    for zone in zones if zones is not None else available_timezones():
        try:
            info = ZoneInfo(zone)
        except (KeyError, OSError, ValueError):
            continue
        for year in range(*years):
            for month in range(1, 13):
                at = datetime(year, month, 15, tzinfo=timezone.utc).astimezone(info)
                if at.tzname() and at.tzname().isalpha():
                    found.setdefault((zone, at.tzname().upper()), set()).add(int(at.utcoffset().total_seconds()))
    return sorted((z, a, o.pop()) for (z, a), o in found.items() if len(o) == 1)


def _fields(text: Column) -> Column:
    """The nine fields as an array, null if the notation is unknown."""
    out = None
    for pattern, to in _NOTATIONS:
        made = F.regexp_replace(text, pattern, to)
        out = F.when(text.rlike(pattern), made) if out is None else out.when(text.rlike(pattern), made)
    return F.split(out, r"\|")


def _local_us(f: Column) -> Column:
    """Microseconds of the wall clock since 1970-01-01 00:00 of that clock; null for impossible dates and times."""
    named = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(F.substring(f[1], 1, 3)))
    month = F.when(f[1].rlike(r"^\d+$"), f[1].try_cast("int")).otherwise(named.cast("int"))
    day = F.concat_ws("-", f[0], F.lpad(month.cast("string"), 2, "0"), F.lpad(f[2], 2, "0")).try_cast("date")
    hour, minute = f[3].try_cast("int"), f[4].try_cast("int")
    second = F.when(f[5] == "", 0).otherwise(f[5].try_cast("int"))
    half = F.lower(f[7])
    hour = F.when(half == "", hour).when((hour < 1) | (hour > 12), None).otherwise(hour % 12 + F.when(half == "p", 12).otherwise(0))
    micro = F.when(f[6] == "", 0).otherwise(F.rpad(F.substring(f[6], 1, 6), 6, "0").try_cast("int"))
    fine = (hour < 24) & (minute < 60) & (second < 60) & month.between(1, 12)
    return F.when(fine, F.unix_date(day).cast("bigint") * _DAY_US + ((hour * 60 + minute) * 60 + second).cast("bigint") * _US + micro)


def with_wall_clock(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the microseconds on the clock that a zone-less stamp was read from; null for stamps with a zone and for numbers."""
    raw, f = fresh(df, "_raw", "_f")
    out = staged(df, **{raw: blank_to_null(text)})
    out = staged(out, **{f: _fields(F.col(raw))})
    return staged(out, **{name: F.when(F.col(f)[8] == "", _local_us(F.col(f)))}).drop(raw, f)


def _shift(us: Column, zone: Column) -> Column:
    """Wall clock (in microseconds) that the zone shows at an instant."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone))


def _by_offset(local: Column, mark: Column) -> Column:
    digits = F.regexp_replace(mark, ":", "")
    off = F.substring(digits, 2, 2).try_cast("int") * 60 + F.coalesce(F.substring(digits, 4, 2).try_cast("int"), F.lit(0))
    off = F.when(off <= 18 * 60, off * F.when(mark.startswith("-"), -1).otherwise(1))
    return local - off.cast("bigint") * 60 * _US


def normalise_stamps(
    df: DataFrame, text: str, zone: str, first: str = "2025-01-01", last: str = "2027-01-01",
    unknown_zone: str = "utc", source: str = "source_path", arrival: str = "received_at", order: Sequence[str] = (),
    rule_s: int | None = None,
) -> DataFrame:
    """Adds ``utc_us`` (microseconds since 1970 UTC, or null) and ``stamp_note`` to the rows of ``df``.

    ``text`` holds the stamp as written, ``zone`` the zone of the machine that wrote it. True instants lie
    in [``first``, ``last``), which settles the unit of a bare number. Notes: ``zone`` (offset or zone
    mark in the value), ``host`` (wall clock in the machine's zone), ``assumed`` (no zone known: UTC, or
    the estimated offset with ``unknown_zone="estimate"``), ``number``, and for null results ``ambiguous``
    (occurs twice), ``skipped`` (never occurs), ``unreadable`` (any other text, a machine zone or
    abbreviation nobody knows, out of range) or ``missing`` (null or blank).
    Rows are neither added nor removed; repeated rows get equal results. The estimate goes by arrival and, with ``order`` (columns,
    the first a number or time), also by the place between lines of the same ``source`` whose instants are known.
    ``rule_s`` is the offset that has to come out where no zone is known, in seconds: an estimate that differs is put right by it and
    noted as ``corrected``.
    """
    spark = df.sparkSession
    raw, own, f, local, mark, region, off, est, first_c, second_c, near, ok1, ok2 = fresh(
        df, "_raw", "_own", "_f", "_local", "_mark", "_region", "_off", "_est", "_first", "_second", "_near", "_ok1", "_ok2")
    upper, hist_day = f"{mark}_u", f"{est}_d"
    lo, hi = (int(datetime.fromisoformat(d).replace(tzinfo=timezone.utc).timestamp()) * _US for d in (first, last))
    zones = sorted(spark._jvm.java.time.ZoneId.getAvailableZoneIds())
    base = df.drop("utc_us", "stamp_note").columns
    out = staged(df, **{raw: blank_to_null(text), own: blank_to_null(zone)})
    out = staged(out, **{f: _fields(F.col(raw))})
    a = F.col(f)
    out = staged(out, **{local: _local_us(a), mark: F.regexp_replace(a[8], r"\s*\[.*$", ""), region: F.regexp_extract(a[8], r"\[([^\]]+)\]", 1)})
    # a bracketed region is a zone mark of the value
    zoned = F.when(F.col(region) != "", F.col(region)).otherwise(F.col(own))
    out = staged(out, **{upper: F.upper(mark), region + "_z": zoned})
    z_c = region + "_z"
    # one row per zone and abbreviation: bounded by the time zone database, not by the data
    names = spark.createDataFrame(abbreviations(zones), f"`{z_c}` string, `{upper}` string, `{off}` int")
    out = out.join(F.broadcast(names), [z_c, upper], "left")
    if unknown_zone == "estimate":
        if order:
            # lines of such machines that state a zone are instants to compare with
            clock, rules = fresh(df, "_clock", "_rules")
            stamped = normalise_stamps(with_wall_clock(df.where(blank_to_null(zone).isNull()), text, clock), text, zone, first, last)
            stamped = stamped.withColumn(rules, F.when(F.col("stamp_note").isin("zone", "number"), F.col("utc_us")))
            stamped = cut(stamped.select(*{source, arrival, *order}, rules, F.when(F.col("stamp_note") == "assumed", F.col(clock)).alias(clock)))
            hist, slot = clock_history(stamped, source, arrival, clock, source, order, rules), F.floor(F.col(local) / _HOUR_US)
        else:
            hist = zone_history(out.where((F.col(mark) == "") & F.col(z_c).isNull()), source, arrival, local).withColumnRenamed("day", "slot")
            slot = F.to_date(arrival)
        hist = cut(hist.select(F.col("source").alias(source), F.col("slot").alias(hist_day), F.col("offset_s").alias(est)))
        hist = F.broadcast(hist) if hist.count() <= _BROADCAST_SLOTS else hist
        out = out.withColumn(hist_day, slot).join(hist, [source, hist_day], "left").drop(hist_day)
    else:
        out = out.withColumn(est, F.lit(0))
    z = F.when(F.col(z_c).isin(zones), F.col(z_c))
    # the reading's instants under the offsets in force a day before and a day after, if they show that reading
    out = staged(out, **{near: F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), z))})
    out = staged(out, **{c: F.col(local) - (_shift(F.col(near) + d, z) - (F.col(near) + d)) for c, d in ((first_c, -_DAY_US), (second_c, _DAY_US))})
    out = staged(out, **{ok1: _shift(F.col(first_c), z) == F.col(local), ok2: _shift(F.col(second_c), z) == F.col(local)})

    number = F.col(raw).rlike(_NUMBER) & F.col(local).isNull()
    # digits that do not fit are beyond any instant of the span, or finer than a microsecond
    value = F.col(raw).try_cast("decimal(38,12)")
    value = F.coalesce(value, F.regexp_replace(F.regexp_replace(raw, r"^\+?0+(?=\d)", ""), r"(\.\d{12})\d+$", "$1").try_cast("decimal(38,12)"))
    inside = lambda c: (c >= lo) & (c < hi)
    units = [F.floor(value * 1_000_000), F.floor(value * 1_000), F.floor(value), F.floor(value / 1_000)]
    from_number = F.coalesce(*[F.when(inside(u), u.cast("bigint")) for u in units])
    twice = F.col(ok1) & F.col(ok2) & (F.col(first_c) != F.col(second_c))
    wall = F.when(twice, None).when(F.col(ok1), F.col(first_c)).when(F.col(ok2), F.col(second_c))
    m = F.col(mark)
    made = (
        F.when(number, from_number)
        .when(F.col(upper).isin(*_UTC_MARKS), F.col(local))
        .when(m.rlike(r"^[+-]"), _by_offset(F.col(local), m))
        .when(m != "", F.col(local) - F.col(off).cast("bigint") * _US)
        .when(F.col(z_c).isNull(), F.col(local) - (F.coalesce(F.col(est), F.lit(0)) if rule_s is None else F.lit(rule_s)).cast("bigint") * _US)
        .otherwise(wall)
    )
    out = staged(out, utc_us=made) if "utc_us" not in df.columns else staged(out.drop("utc_us"), utc_us=made)
    utc = F.when(inside(F.col("utc_us")), F.col("utc_us"))
    clock = F.col(local).isNotNull() & (m == "") & z.isNotNull()
    note = (
        F.when(F.col(raw).isNull(), "missing")
        .when(utc.isNull() & clock & twice, "ambiguous")
        .when(utc.isNull() & clock & ~F.col(ok1) & ~F.col(ok2), "skipped")
        .when(utc.isNull(), "unreadable")
        .when(number, "number").when(m != "", "zone").when(F.col(z_c).isNull(), F.lit("assumed") if rule_s is None else F.when(F.coalesce(F.col(est), F.lit(0)) != rule_s, "corrected").otherwise("assumed")).otherwise("host")
    )
    return out.select(*base, utc.alias("utc_us"), note.alias("stamp_note"))


def line_stamps(lines: DataFrame, *keep: str) -> DataFrame:
    """Log lines with the stamp of their body: ``record_id, source_path, host_tz, received_at, raw`` and the columns to keep."""
    body = F.from_json("body", "timestamp string, createdAt string, ts string")
    names = ["record_id", "source_path", "host_tz", "received_at", *keep]
    return lines.select(*names, body.alias("_b")).select(*names, F.coalesce("_b.timestamp", "_b.createdAt", "_b.ts").alias("raw"))


def _history(votes: list[tuple[int, int | None, int]]) -> Iterator[tuple[int, int | None, int, int]]:
    """(slot, offset, lines, violations) from (slot, offset, votes) of one source, by Viterbi over its slots (days, hours):
    violations of an offset are the lines that vote for another;
    a change of offset costs as much as ``_CHANGE`` violations. Ties take the offset nearest to UTC. Votes for no
    possible offset (null) are violations of all; a source with no other has no offset."""
    by: dict[int, dict] = {}
    for slot, offset, n in votes:
        by.setdefault(slot, {})[offset] = n
    cands = sorted({o for _, o, _ in votes if o is not None}, key=lambda o: (abs(o), o)) or [None]
    cost = dict.fromkeys(cands, 0.0)
    ways: list[dict] = []
    slots = sorted(by)
    for slot in slots:
        total = sum(by[slot].values())
        best = min(cands, key=lambda o: cost[o])
        step, back = {}, {}
        for o in cands:
            stay = cost[o] <= cost[best] + _CHANGE
            step[o] = (cost[o] if stay else cost[best] + _CHANGE) + total - by[slot].get(o, 0)
            back[o] = o if stay else best
        cost = step
        ways.append(back)
    at = min(cands, key=lambda o: cost[o])
    for slot, back in zip(reversed(slots), reversed(ways)):
        lines = sum(by[slot].values())
        yield slot, at, lines, lines - (by[slot].get(at, 0) if at is not None else 0)
        at = back[at]


def _histories(votes: DataFrame) -> DataFrame:
    """``_history`` of every source; its votes are one row per slot and offset and come together in one task."""
    names = ["source", "slot", "offset_s", "lines", "violations"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, out = None, [], []

        def done() -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=names)

        for batch in batches:
            for source, slot, offset, n in zip(*(c.to_pylist() for c in batch.columns)):
                if source != held and rows:
                    out += [(held, *r) for r in _history(rows)]
                    rows = []
                    if len(out) > 20_000:
                        yield done()
                        out.clear()
                held = source
                rows.append((slot, offset, n))
        out += [(held, *r) for r in _history(rows)] if rows else []
        yield done()

    placed = votes.select(F.col("source").cast("string").alias("source"), "slot", "offset_s", "n").repartition("source").sortWithinPartitions("source")
    return placed.mapInArrow(run, "source string, slot bigint, offset_s int, lines bigint, violations bigint")


_CHANGE = 3.0


_HOUR_US = 3_600 * _US
_BROADCAST_SLOTS = 200_000  # slots of histories that are broadcast; more are joined by shuffle


def _votes(df: DataFrame, source: str, arrival: str, local_us: str, slot: Column, step_s: int, slack_s: int, file: str | None = None, order: Sequence[str] = (), known_us: str | None = None) -> DataFrame:
    """``(source, slot, offset_s, n)``: votes of the lines, counted before any grouping, so a group holds at most one row per slot and
    offset however many lines a source has."""
    arrived, local, step = F.unix_micros(F.col(arrival).cast("timestamp")), F.col(local_us), step_s * _US
    vote = F.ceil((local - arrived) / step - slack_s / step_s) * step_s
    if known_us:
        before, behind = fresh(df, "_before", "_behind")
        df = carried(df, [file], order, F.col(known_us), "last", before)
        df = carried(df, [file], order, F.col(known_us), "next", behind)
        least, most = F.ceil((local - F.col(behind)) / step) * step_s, F.floor((local - F.col(before)) / step) * step_s
        vote = F.when(least == most, least).when((F.coalesce(least, vote) <= vote) & (vote <= F.coalesce(most, vote)), vote)
    return (
        df.where(F.col(local_us).isNotNull() & F.col(arrival).isNotNull() & F.col(source).isNotNull())
        .select(F.col(source).alias("source"), slot.alias("slot"), vote.alias("_vote"))
        .groupBy("source", "slot", F.when(F.abs("_vote") <= 14 * 3600, F.col("_vote")).cast("int").alias("offset_s")).agg(F.count(F.lit(1)).alias("n"))
    )


def zone_history(df: DataFrame, source: str, arrival: str, local_us: str, step_s: int = 900, slack_s: int = 60) -> DataFrame:
    """Estimated offsets of sources that state no zone: ``(source, day, offset_s, lines, violations)`` by day of arrival.

    A line arrives a little after it was written, so local time minus arrival, rounded up to the next
    quarter of an hour (with ``slack_s`` of tolerance), votes for an offset; a line that arrives late votes
    for an offset that is too small and is a violation of the true one. Beyond 14 hours it votes for none, and a
    day with only such lines has the offset of the days around it.
    """
    slot = F.unix_date(F.to_date(arrival)).cast("bigint")
    out = _histories(_votes(df, source, arrival, local_us, slot, step_s, slack_s))
    return out.select("source", F.date_from_unix_date(F.col("slot").cast("int")).alias("day"), "offset_s", "lines", "violations")


def clock_history(df: DataFrame, source: str, arrival: str, local_us: str, file: str, order: Sequence[str], known_us: str, step_s: int = 900, slack_s: int = 60) -> DataFrame:
    """Estimated offsets by hour of the wall clock, from arrival and sequence: ``(source, slot, offset_s, lines, violations)``.

    As ``zone_history``, but a late line belongs to the hour it was written in, and ``known_us``, instants that other lines of the same ``file``
    are known to have, tell as well: in the ``order`` of the file a line lies between its nearest known
    neighbours. If that leaves one offset it is the vote, and a vote by arrival that it rules out counts for none. ``slot`` is the
    hour of the wall clock since 1970.
    """
    slot = F.floor(F.col(local_us) / _HOUR_US)
    return _histories(_votes(df, source, arrival, local_us, slot, step_s, slack_s, file, order, known_us))


def zone_accuracy(lines: DataFrame, source: str, text: str, zone: str, arrival: str, file: str, order: Sequence[str]) -> DataFrame:
    """How often the estimate hits where the zone is known: ``(source, lines, right_lines)`` of the wall-clock stamps.

    ``lines`` state their zone; the estimate does not look at it, and the offset by the rules is what it is held against.
    """
    known, local = fresh(lines, "_known", "_local")
    ruled = normalise_stamps(with_wall_clock(lines, text, local), text, zone)
    ruled = ruled.withColumn(known, F.when(F.col("stamp_note").isin("zone", "number"), F.col("utc_us")))
    ruled = cut(ruled.select(*{source, arrival, file, *order}, "stamp_note", "utc_us", local, known))
    hist = clock_history(ruled, source, arrival, local, file, order, known)
    host = ruled.where(F.col("stamp_note") == "host").select(F.col(source).alias("source"), F.floor(F.col(local) / _HOUR_US).alias("slot"), ((F.col(local) - F.col("utc_us")) / _US).cast("int").alias("true_s"))
    right = F.coalesce(F.col("true_s") == F.col("offset_s"), F.lit(False))
    return host.join(hist.select("source", "slot", "offset_s"), ["source", "slot"], "left").groupBy("source").agg(F.count(F.lit(1)).alias("lines"), F.count_if(right).alias("right_lines"))
