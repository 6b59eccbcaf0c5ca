"""Problem 2: rolling totals over trailing periods, days without activity included.

Method: event-contribution deltas. The amount of a day is added at its date and taken away again
when it leaves the window, so the running sum of the deltas is the trailing total. Amounts are
first summed per entity and day (partial aggregation), which bounds an entity's deltas by the
length of its calendar however many rows it has. Between two deltas a total is constant: the
running sums are made on the sparse deltas and only then spread over the calendar.

Amounts are added as decimals, so that a window that empties gives exactly zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SUM = "decimal(38,12)"


def latest_rebuild(daily: DataFrame, key: Sequence[str], version: str = "rebuild_no") -> DataFrame:
    """One row per key, that of the highest ``version``; of several with that version the one with the largest other
    columns, so rows repeated exactly count once. Null keys are values."""
    rest = [c for c in daily.columns if c not in key]
    best = daily.groupBy(*key).agg(F.max(F.struct(F.col(version), *[F.col(c) for c in rest if c != version])).alias("_best"))
    return best.select(*key, *[F.col(f"_best.{c}").alias(c) for c in rest])


def trailing_intervals(rows: DataFrame, entity: Sequence[str], day: str, amount: str, windows: Sequence[int], end: Column) -> DataFrame:
    """Sparse form: one row per stretch of days with constant totals.

    Columns: the entity, ``from_day``, ``to_day`` (inclusive) and for every window n ``total_n`` (decimal),
    ``high_n`` (the highest total of the entity's earlier stretches, null on the first). The calendar of an
    entity runs from its first row's day to ``end``, later rows are left out. Null amounts add nothing but
    their day counts as having a row; rows with a null day or a null entity are ignored.
    """
    ent = [F.col(c) for c in entity]
    base = rows.select(*ent, F.col(day).cast("date").alias("_d"), F.col(amount).cast(_SUM).alias("_a"))
    for c in entity:
        base = base.where(F.col(c).isNotNull())
    daily = (
        base.where(F.col("_d") <= end).groupBy(*entity, "_d").agg(F.coalesce(F.sum("_a"), F.lit(0)).cast(_SUM).alias("_a"))
    )
    # at most one row per calendar day of an entity: from here on an entity fits a task, and nothing is shuffled again
    daily = daily.repartition(*entity)
    zero = F.lit(0).cast(_SUM)
    parts = [F.struct(F.lit(0).alias("lag"), *[F.lit(1).alias(f"s{n}") for n in windows])]
    parts += [F.struct(F.lit(n).alias("lag"), *[F.lit(-1 if n == m else 0).alias(f"s{m}") for m in windows]) for n in windows]
    deltas = daily.select(*ent, "_d", "_a", F.explode(F.array(*parts)).alias("p")).select(
        *ent, F.date_add("_d", F.col("p.lag")).alias("_d"), *[(F.col("_a") * F.col(f"p.s{n}")).cast(_SUM).alias(f"_x{n}") for n in windows])
    deltas = deltas.where(F.col("_d") <= end).groupBy(*entity, "_d").agg(*[F.sum(f"_x{n}").cast(_SUM).alias(f"_x{n}") for n in windows])
    w = Window.partitionBy(*entity).orderBy("_d")
    run = deltas.select(*ent, F.col("_d").alias("from_day"), F.coalesce(F.date_sub(F.lead("_d").over(w), 1), end).alias("to_day"),
                        *[F.coalesce(F.sum(f"_x{n}").over(w.rowsBetween(Window.unboundedPreceding, 0)), zero).cast(_SUM).alias(f"total_{n}") for n in windows])
    back = Window.partitionBy(*entity).orderBy("from_day").rowsBetween(Window.unboundedPreceding, -1)
    return run.select("*", *[F.max(F.round(f"total_{n}", 6)).over(back).alias(f"high_{n}") for n in windows])


def trailing_totals(rows: DataFrame, entity: Sequence[str], day: str, amount: str, windows: Sequence[int], end: Column) -> DataFrame:
    """Dense form: one row per entity and calendar day with ``total_n``, ``avg_n`` (the total over n) and
    ``new_high_n`` (the total, rounded to 6 decimals, is above that of every earlier day; false on the first day)."""
    sparse = trailing_intervals(rows, entity, day, amount, windows, end)
    spread = sparse.withColumn("day", F.explode(F.sequence("from_day", "to_day")))
    cols = []
    for n in windows:
        total = F.round(f"total_{n}", 6)
        cols += [total.cast("double").alias(f"total_{n}"), F.round(F.col(f"total_{n}") / n, 6).cast("double").alias(f"avg_{n}"),
                 ((F.col("day") == F.col("from_day")) & F.coalesce(total > F.col(f"high_{n}"), F.lit(False))).alias(f"new_high_{n}")]
    return spread.select(*entity, "day", *cols)
