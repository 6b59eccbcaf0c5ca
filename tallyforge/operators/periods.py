"""Reporting periods of a time zone: half-open intervals that become literals of a plan."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone, tzinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def day_start(day: date, zone: tzinfo) -> datetime:
    """Earliest instant of a local date, in UTC; where midnight does not exist, the first instant after the gap."""
    for minute in range(0, 24 * 60, 15):
        local = datetime(day.year, day.month, day.day, minute // 60, minute % 60, tzinfo=zone)
        utc = local.astimezone(timezone.utc)
        if utc.astimezone(zone).date() == day:
            # the gap may end between two quarters, and the day before may have ended later than it seems
            step = timedelta(minutes=1)
            while (utc - step).astimezone(zone).date() == day:
                utc -= step
            return utc
    return datetime(day.year, day.month, day.day, tzinfo=timezone.utc)  # the date was skipped as a whole


@dataclass(frozen=True)
class Period:
    """Calendar period ``first`` (inclusive) to ``last`` (exclusive) and its instants."""

    first: date
    last: date
    start: datetime
    end: datetime

    def holds(self, ts: str = "ts") -> Column:
        return (F.col(ts) >= F.lit(self.start)) & (F.col(ts) < F.lit(self.end))


def _made(first: date, last: date, zone: tzinfo) -> Period:
    return Period(first, last, day_start(first, zone), day_start(last, zone))


def _month(day: date, by: int = 0) -> date:
    n = day.year * 12 + day.month - 1 + by
    return date(n // 12, n % 12 + 1, 1)


def period(kind: str, day: date, zone: tzinfo) -> Period:
    """The ``day``, ``week`` (from Monday) or ``month`` that holds a local date."""
    if kind == "day":
        return _made(day, day + timedelta(days=1), zone)
    if kind == "week":
        monday = day - timedelta(days=day.weekday())
        return _made(monday, monday + timedelta(days=7), zone)
    if kind == "month":
        return _made(_month(day), _month(day, 1), zone)
    raise ValueError(kind)


def previous(kind: str, p: Period, zone: tzinfo) -> Period:
    return period(kind, p.first - timedelta(days=1), zone)


def comparison(kind: str, p: Period, now: datetime, zone: tzinfo) -> tuple[datetime, datetime]:
    """The part of the previous period that is as long as the elapsed part of this one, at most all of it."""
    before = previous(kind, p, zone)
    elapsed = min(max(now, p.start), p.end) - p.start
    return before.start, min(before.start + elapsed, before.end)


def period_sums(events: DataFrame, periods: dict[str, Period | tuple[datetime, datetime]], measure: Column) -> DataFrame:
    """One row with the sum of a measure per named period, in a single scan that reads only what some period needs."""
    spans = {n: (p.start, p.end) if isinstance(p, Period) else p for n, p in periods.items()}
    inside = {n: (F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(b)) for n, (a, b) in spans.items()}
    lo, hi = min(a for a, _ in spans.values()), max(b for _, b in spans.values())
    rows = events.where((F.col("ts") >= F.lit(lo)) & (F.col("ts") < F.lit(hi)))
    return rows.agg(*[F.coalesce(F.sum(F.when(c, measure)), F.lit(0)).alias(n) for n, c in inside.items()])


def delta(now: Column, before: Column, dead: float = 0.005) -> Column:
    """Change against an earlier value; within the dead band it is 0, without an earlier value null."""
    d = F.try_divide(now, before) - 1
    return F.when(F.abs(d) <= dead, 0.0).otherwise(d)
