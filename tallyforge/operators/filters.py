"""Filters of the read API, compiled to predicates, and the time grammar of the command line."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone, tzinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filter:
    """Conjunction of conditions; an empty one holds for all rows. The time range is half-open."""

    start: datetime | None = None
    end: datetime | None = None
    harnesses: Sequence[str] = ()
    instances: Sequence[str] = ()
    providers: Sequence[str] = ()
    provider_ids: Sequence[str] = ()
    models: Sequence[str] = ()
    project: str | None = None

    def pushed(self) -> Column:
        """The part that reaches the scan: raw columns only."""
        out = F.lit(True)
        if self.start is not None:
            out = out & (F.col("ts") >= F.lit(self.start))
        if self.end is not None:
            out = out & (F.col("ts") < F.lit(self.end))
        for column, wanted in (("harness", self.harnesses), ("instance_id", self.instances)):
            if wanted:
                out = out & F.col(column).isin(list(wanted))
        return out & (F.col("project") == self.project) if self.project is not None else out

    def derived(self) -> Column:
        """The part over computed columns: resolved provider, model after aliases, provider identity."""
        out = F.lit(True)
        for column, wanted in (("resolved_provider", self.providers), ("model", self.models), ("provider_id", self.provider_ids)):
            if wanted:
                out = out & F.col(column).isin(list(wanted))
        return out


def with_aliases(events: DataFrame, aliases: DataFrame) -> DataFrame:
    """Model names after one hop of renames: an alias for the provider before one for all (blank provider)."""
    own = aliases.where("provider <> ''").select(F.col("source").alias("model"), F.col("provider").alias("resolved_provider"), F.col("target").alias("_own"))
    for_all = aliases.where("provider = ''").select(F.col("source").alias("model"), F.col("target").alias("_all"))
    out = events.join(own, ["model", "resolved_provider"], "left").join(for_all, "model", "left")
    return out.withColumn("model", F.coalesce("_own", "_all", "model")).select(*events.columns)


def search(df: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """Rows in which every word of ``text`` occurs somewhere in the columns, letter case aside."""
    hay = F.lower(F.concat_ws(" ", *columns))
    for word in text.lower().split():
        df = df.where(hay.contains(word))
    return df


def starts_with(column: str, prefix: str) -> Column:
    """Literal prefix; no character is a wildcard."""
    return F.col(column).startswith(prefix)


_SPAN = re.compile(r"(\d+)\s*(s|h|d|w|m|mo|months?)")


def parse_time(text: str, now: datetime, zone: tzinfo = timezone.utc) -> datetime:
    """Start of ``today``, ``yesterday``, ``week`` (Monday) or ``month``, a date, an RFC 3339 instant, or a span before now
    (``90s 12h 7d 2w 3m``; m are calendar months)."""
    text = text.strip().lower()
    local = now.astimezone(zone)
    today = datetime(local.year, local.month, local.day, tzinfo=zone)
    named = {"today": today, "yesterday": today - timedelta(days=1), "week": today - timedelta(days=today.weekday()), "month": today.replace(day=1)}
    if text in named:
        return named[text]
    if m := _SPAN.fullmatch(text):
        n, unit = int(m.group(1)), m.group(2)
        if unit.startswith("m"):
            months = local.year * 12 + local.month - 1 - n
            y, mo = divmod(months, 12)
            last = (date(y + (mo == 11), (mo + 1) % 12 + 1, 1) - timedelta(days=1)).day
            return local.replace(year=y, month=mo + 1, day=min(local.day, last))
        return now - n * {"s": timedelta(seconds=1), "h": timedelta(hours=1), "d": timedelta(days=1), "w": timedelta(weeks=1)}[unit]
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        return datetime.fromisoformat(text).replace(tzinfo=zone)
    out = datetime.fromisoformat(text.upper().replace("Z", "+00:00"))
    return out if out.tzinfo else out.replace(tzinfo=zone)
