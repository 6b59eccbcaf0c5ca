"""Temporal and ordered joins that Spark has no operator for."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.runtime import fresh


def asof_backward(left: DataFrame, right: DataFrame, on: Sequence[str], at: str, since: str, values: Sequence[str], block_s: int = 86_400) -> DataFrame:
    """Adds the ``values`` of the latest right row of the same key with ``since`` <= ``at`` (null if there is none).

    Both sides go through one ordered pass: right rows carry their values forward over the left rows of their
    key. The pass is cut into blocks of time, so a hot key is many tasks: each block starts from the last
    right row before it, found from one row per key and block. Equal ``since`` take the largest values.
    """
    blk, side, t, val, row, fill, start = fresh(left, "_blk", "_side", "_t", "_val", "_row", "_fill", "_start")
    key = list(on)
    block = F.floor(F.col(t).cast("double") / block_s)
    r = right.where(F.col(since).isNotNull()).groupBy(*key, F.col(since).alias(t)).agg(F.max(F.struct(*values)).alias(val)).withColumn(side, F.lit(0))
    lf = left.withColumn(t, F.col(at)).withColumn(row, F.struct(*left.columns)).select(*key, t, row).withColumn(side, F.lit(1))
    both = r.unionByName(lf, allowMissingColumns=True).withColumn(blk, block)
    inner = Window.partitionBy(*key, blk).orderBy(F.col(t).asc_nulls_first(), side).rowsBetween(Window.unboundedPreceding, 0)
    ends = both.groupBy(*key, blk).agg(F.max_by(val, F.when(F.col(side) == 0, F.col(t))).alias(fill))
    outer = Window.partitionBy(*key).orderBy(F.col(blk).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*key, blk, F.last(fill, ignorenulls=True).over(outer).alias(start))
    ends = ends.select(*[F.col(k).alias(f"{start}_{k}") for k in key], F.col(blk).alias(f"{start}_b"), start)
    seen = both.withColumn(fill, F.when(F.col(t).isNotNull(), F.last(val, ignorenulls=True).over(inner)))
    cond = F.col(blk) == F.col(f"{start}_b")
    for k in key:
        cond = cond & F.col(k).eqNullSafe(F.col(f"{start}_{k}"))
    hit = F.coalesce(F.col(fill), F.col(start))
    return seen.where(F.col(side) == 1).join(ends, cond, "left").select(f"{row}.*", *[hit[v].alias(v) for v in values])


def nearest_within(left: DataFrame, right: DataFrame, on: Sequence[str], at: str, right_at: str, tolerance_s: float, left_id: str, order: str, values: Sequence[str]) -> DataFrame:
    """Left rows with the right row of the same key nearest in time, at most ``tolerance_s`` away; the first by ``order`` of equals.

    Time is cut into buckets of the tolerance: every right row is looked up in its own bucket and the two beside it, so the
    join is an equi-join whose groups are bounded by the rows of three buckets.
    """
    lb, rb = fresh(left, "_lb", "_rb")
    bucket = lambda c: F.floor(F.unix_micros(c) / F.lit(int(tolerance_s * 1e6)))
    rs = right.select(*[F.col(k).alias(f"_r_{k}") for k in on], F.col(right_at).alias("_r_at"), F.col(order).alias("_r_ord"), *[F.col(v).alias(f"_r_v_{v}") for v in values],
                      F.explode(F.array(*[bucket(F.col(right_at)) + d for d in (-1, 0, 1)])).alias(rb))
    cond = F.col(lb) == F.col(rb)
    for k in on:
        cond = cond & (F.col(k) == F.col(f"_r_{k}"))
    gap = F.abs(F.unix_micros(at) - F.unix_micros("_r_at"))
    hits = left.withColumn(lb, bucket(F.col(at))).join(rs, cond).where(gap <= int(tolerance_s * 1e6))
    best = hits.groupBy(left_id).agg(F.min(F.struct(gap.alias("gap"), F.col("_r_ord"), *[F.col(f"_r_v_{v}") for v in values])).alias("_best"))
    return left.join(best, left_id, "left").select(*left.columns, *[F.col(f"_best._r_v_{v}").alias(v) for v in values])


def first_matching_rule(df: DataFrame, rules: Sequence[dict], condition: Callable[[dict], Column], name: str, value: str, bound: int = 1_000) -> DataFrame:
    """Adds ``name``: the ``value`` of the first rule in list order whose condition holds, null if none does.

    Rules are a hand-written list (more than ``bound`` raise): they become one CASE expression, so rows are neither
    joined nor shuffled.
    """
    if len(rules) > bound:
        raise ValueError(f"{len(rules)} rules; at most {bound} make one expression")
    out = None
    for r in rules:
        out = F.when(condition(r), F.lit(r[value])) if out is None else out.when(condition(r), F.lit(r[value]))
    return df.withColumn(name, out if out is not None else F.lit(None).cast("string"))


def interval_anti(left: DataFrame, right: DataFrame, on: Sequence[str], at: str, right_at: str, within_s: float) -> DataFrame:
    """Left rows without a right row of the same key within ``within_s``; bucketed like ``nearest_within``."""
    lb, rb = fresh(left, "_lb", "_rb")
    bucket = lambda c: F.floor(F.unix_micros(c) / F.lit(int(within_s * 1e6)))
    rs = right.select(*[F.col(k).alias(f"_r_{k}") for k in on], F.col(right_at).alias("_r_at"), F.explode(F.array(*[bucket(F.col(right_at)) + d for d in (-1, 0, 1)])).alias(rb))
    cond = (F.col(lb) == F.col(rb)) & (F.abs(F.unix_micros(at) - F.unix_micros("_r_at")) <= int(within_s * 1e6))
    for k in on:
        cond = cond & (F.col(k) == F.col(f"_r_{k}"))
    return left.withColumn(lb, bucket(F.col(at))).join(rs, cond, "left_anti").drop(lb)
