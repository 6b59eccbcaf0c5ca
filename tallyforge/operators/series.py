"""Time series: dense days and hours, folded bars, cumulative sums and strips."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense(df: DataFrame, ts: str, measures: Sequence[str], unit: str = "DAY", start: Column | None = None, end: Column | None = None) -> DataFrame:
    """One row per calendar day or hour of the session's zone from ``start`` to before ``end``, empty ones as zeros.

    Open ends take the data's first and last bucket; without data and ends there are no rows. Buckets step by
    calendar days, so days of 23 or 25 hours are one bucket each. Rows outside the range are left out.
    """
    rows = df if start is None else df.where(F.col(ts) >= start)
    rows = rows if end is None else rows.where(F.col(ts) < end)
    sums = rows.groupBy(F.date_trunc(unit, ts).alias("bucket")).agg(*[F.sum(m).alias(m) for m in measures])
    step = F.expr("interval 1 hour" if unit == "HOUR" else "interval 1 day")
    lo = F.date_trunc(unit, start) if start is not None else F.min("bucket")
    hi = end if end is not None else F.max("bucket") + step
    span = sums.agg(lo.alias("lo"), hi.alias("hi")).where("lo < hi")
    axis = span.select(F.explode(F.sequence("lo", F.col("hi") - F.expr("interval 1 microsecond"), step)).alias("bucket"))
    return axis.join(sums, "bucket", "left").fillna(0, list(measures))


def fold_bars(days: DataFrame, day: str, measure: str, daily_max: int = 180, weekly_max: int = 1095) -> DataFrame:
    """Bars of a dense daily series: days while it is short, weeks counted back from the newest day, else calendar months."""
    both = days.withColumns({"_n": days.agg(F.count(F.lit(1))).scalar(), "_last": days.agg(F.max(day)).scalar()})
    week = F.date_sub("_last", (F.floor(F.datediff("_last", day) / 7) * 7 + 6).cast("int"))
    start = F.when(F.col("_n") <= daily_max, F.col(day).cast("date")).when(F.col("_n") <= weekly_max, week).otherwise(F.trunc(day, "MONTH"))
    unit = F.when(F.col("_n") <= daily_max, "day").when(F.col("_n") <= weekly_max, "week").otherwise("month")
    return both.groupBy(start.alias("_s"), unit.alias("unit")).agg(
        F.min(day).cast("date").alias("first_day"), F.max(day).cast("date").alias("last_day"), F.sum(measure).alias(measure)).drop("_s")


def cumulative(days: DataFrame, day: str, measure: str, by: Sequence[str] = (), name: str = "running") -> DataFrame:
    """Running sum of a dense series, per ``by``."""
    w = Window.partitionBy(*by).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return days.withColumn(name, F.round(F.sum(measure).over(w), 6))


def top_k(df: DataFrame, key: str, measure: str, k: int) -> DataFrame:
    """The k keys with the largest sums, ties by key."""
    return df.groupBy(key).agg(F.sum(measure).alias("_m")).orderBy(F.desc("_m"), key).limit(k).select(key)


def strip(df: DataFrame, bucket: Column, key: str, measure: str, k: int, other: str = "other") -> DataFrame:
    """Sums per bucket and key, with all keys but the k largest folded into ``other``; the k-row list is broadcast."""
    top = top_k(df, key, measure, k).withColumn("_top", F.lit(True))
    named = df.join(F.broadcast(top), key, "left").withColumn(key, F.when(F.col("_top"), F.col(key)).otherwise(other))
    return named.groupBy(bucket.alias("bucket"), key).agg(F.sum(measure).alias(measure))


def streaks(days: DataFrame, day: str, active: Column) -> DataFrame:
    """Runs of consecutive active days of a dense series: ``(first_day, last_day, length, current)``.

    A run is current if it reaches the last day of the series, or the day before while the last one is still empty.
    """
    end = days.agg(F.max(day)).scalar()
    on = days.where(active).select(F.col(day).cast("date").alias("d"))
    w = Window.orderBy("d")  # one row per calendar day
    runs = on.withColumn("_g", F.date_sub("d", F.row_number().over(w))).groupBy("_g").agg(
        F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.count(F.lit(1)).alias("length"))
    return runs.select("first_day", "last_day", "length", (F.datediff(end, F.col("last_day")) <= 1).alias("current"))


def heat_levels(days: DataFrame, cost: str, tokens: str) -> DataFrame:
    """Level 0 to 4 of every day by the quartiles of the days that cost something; 0 only without cost and tokens.

    The sorted costs are one array as long as the calendar.
    """
    q = days.agg(F.sort_array(F.collect_list(F.when(F.col(cost) > 0, F.col(cost))))).scalar()
    at = lambda f: F.when(F.size("_q") > 0, F.get("_q", F.least(F.floor(F.size("_q") * f), F.size("_q") - 1).cast("int"))).otherwise(0.0)
    c = F.col(cost)
    level = F.when((c <= 0) & (F.col(tokens) == 0), 0).when(c <= at(0.25), 1).when(c <= at(0.5), 2).when(c <= at(0.75), 3).otherwise(4)
    return days.withColumn("_q", q).withColumn("level", level).drop("_q")
