"""Ordered analytics: deltas, suppression, forward fill, boundaries, rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.runtime import fresh


def _block(df: DataFrame, column: str, size: float) -> Column:
    """Stretch of the order that a row lies in: days of a timestamp, or ``size`` steps of a number."""
    if dict(df.dtypes)[column].startswith("timestamp"):
        return F.floor(F.unix_micros(F.col(column).cast("timestamp")) / (86_400_000_000 * size))
    return F.floor(F.col(column) / (100_000 * size))


def carried(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, how: str, name: str, size: float = 1.0) -> DataFrame:
    """Adds a running value per ``by``, in ``order`` (the first column a timestamp or number), without one task per group.

    ``how``: ``sum`` (up to the row), ``max_before`` (of earlier rows), ``last`` (last non-null up to the row), ``next`` (first
    non-null from the row on) or ``lag`` (the row before). The order is cut into blocks; each block runs by itself and
    starts from what the blocks before (or after) it come to, found from one row per group and block. However large a
    group is, a task holds no more than one of its blocks.
    """
    val, blk, own, end, rest = fresh(df, "_val", "_blk", "_own", "_end", "_rest")
    rows = df.withColumns({val: value, blk: _block(df, order[0], size)})
    inner = Window.partitionBy(*by, blk).orderBy(*order)
    before, here, on = inner.rowsBetween(Window.unboundedPreceding, -1), inner.rowsBetween(Window.unboundedPreceding, 0), inner.rowsBetween(0, Window.unboundedFollowing)
    place = F.struct(*order)
    stated = F.when(F.col(val).isNotNull(), place)
    over_own, of_block = {
        "sum": (F.sum(val).over(here), F.sum(val)), "max_before": (F.max(val).over(before), F.max(val)),
        "last": (F.last(val, ignorenulls=True).over(here), F.max_by(val, stated)), "next": (F.first(val, ignorenulls=True).over(on), F.min_by(val, stated)),
        "lag": (F.lag(F.struct(val)).over(inner), F.max_by(F.struct(val), place)),
    }[how]
    outer = Window.partitionBy(*by).orderBy(F.col(blk).asc_nulls_first())
    past, ahead = outer.rowsBetween(Window.unboundedPreceding, -1), outer.rowsBetween(1, Window.unboundedFollowing)
    e = F.col(end)
    carry = {"sum": F.sum(e).over(past), "max_before": F.max(e).over(past), "last": F.last(e, ignorenulls=True).over(past), "next": F.first(e, ignorenulls=True).over(ahead), "lag": F.lag(e).over(outer)}[how]
    keys = {k: f"{rest}_{i}" for i, k in enumerate([*by, blk])}
    ends = rows.groupBy(*by, blk).agg(of_block.alias(end)).withColumn(rest, carry).select(*[F.col(k).alias(v) for k, v in keys.items()], rest)
    cond = F.lit(True)
    for k, v in keys.items():
        cond = cond & F.col(k).eqNullSafe(F.col(v))
    out = rows.withColumn(own, over_own).join(ends, cond, "left")
    both = {
        "sum": F.when(F.col(own).isNotNull() | F.col(rest).isNotNull(), F.coalesce(own, F.lit(0)) + F.coalesce(rest, F.lit(0))), "max_before": F.greatest(own, rest),
        "last": F.coalesce(own, rest), "next": F.coalesce(own, rest), "lag": F.coalesce(own, rest)[val],
    }[how]
    return out.withColumn(name, both).select(*[c for c in df.columns if c != name], name)


def cumulative_delta(df: DataFrame, by: Sequence[str], order: Sequence[str], counter: str, name: str = "delta") -> DataFrame:
    """Increments of a cumulative counter against its high-water mark: a counter that falls adds nothing until it exceeds it."""
    (high,) = fresh(df, "_high")
    out = carried(df, by, order, F.col(counter), "max_before", high)
    return out.withColumn(name, F.greatest(F.col(counter) - F.coalesce(high, F.lit(0)), F.lit(0))).drop(high)


def suppress_repeats(df: DataFrame, by: Sequence[str], order: Sequence[str], snapshot: Sequence[str]) -> DataFrame:
    """Rows whose snapshot differs from the one before; the first row of a group always stays."""
    (old,) = fresh(df, "_old")
    out = carried(df, by, order, F.struct(*snapshot), "lag", old)
    return out.where(~F.col(old).eqNullSafe(F.struct(*snapshot))).drop(old)


def forward_fill(df: DataFrame, by: Sequence[str], order: Sequence[str], column: str, name: str) -> DataFrame:
    """The last stated value (not null, not blank) up to each row."""
    return carried(df, by, order, F.nullif(F.col(column), F.lit("")), "last", name)


def back_fill(df: DataFrame, by: Sequence[str], order: Sequence[str], column: str, name: str) -> DataFrame:
    """The next stated value from each row on."""
    return carried(df, by, order, F.nullif(F.col(column), F.lit("")), "next", name)


def inferred_compaction(df: DataFrame, by: Sequence[str], order: Sequence[str], size: str, name: str = "compacted") -> DataFrame:
    """True where a context shrinks below half (integer division) of the one before."""
    (old,) = fresh(df, "_old")
    out = carried(df, by, order, F.col(size), "lag", old)
    return out.withColumn(name, F.coalesce(F.col(size) < F.floor(F.col(old) / 2), F.lit(False))).drop(old)


def pending_boundary(df: DataFrame, by: Sequence[str], order: Sequence[str], marker: str, key: str, name: str = "applied") -> DataFrame:
    """A boundary marker between requests belongs to the next distinct request key: rows with a key get the last marker
    since the row of the key before."""
    w = Window.partitionBy(*by).orderBy(*order)
    keyed = F.nullif(F.col(key), F.lit(""))
    before = F.last(keyed, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = keyed.isNotNull() & ~keyed.eqNullSafe(before)
    seg = F.coalesce(F.sum(F.col("_fresh").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = df.withColumn("_fresh", fresh).withColumn("_seg", seg)
    mark = F.last(F.nullif(F.col(marker), F.lit("")), ignorenulls=True).over(Window.partitionBy(*by, "_seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn(name, F.when(F.col("_fresh"), F.coalesce(mark, F.lit(""))).otherwise("")).drop("_fresh", "_seg")


def running_sum(df: DataFrame, by: Sequence[str], order: Sequence[str], measure: str, name: str) -> DataFrame:
    """Running sum per group, rounded to 6 decimals."""
    return carried(df, by, order, F.col(measure), "sum", name).withColumn(name, F.round(name, 6))


def output_rate(events: DataFrame, by: Sequence[str], now: Column, live_s: int = 90, count_s: int = 600, fastest: int = 300) -> DataFrame:
    """Output tokens per second per session at ``now``, and requests in the last ten minutes.

    Requests with a measured decode time are the answer if there are any (output only). Else output and reasoning tokens of the
    last ``live_s`` seconds over the gaps to the request before: longer gaps are pauses and drop out, shorter ones count as at least
    the time the tokens take at ``fastest``. The first request of a session has no predecessor and is never counted.
    """
    us = F.unix_micros("ts")
    lagged = carried(events, by, ["ts", "dedup_key"], F.col("ts"), "lag", "_prev")
    age, gap = (F.unix_micros(now) - us) / 1e6, (us - F.unix_micros("_prev")) / 1e6
    e = lagged.withColumn("_age", age).withColumn("_gap", gap).where(F.col("_gap").isNotNull() & (F.col("_age") <= count_s))
    live, timed = F.col("_age") <= live_s, F.col("decode_ms") > 0
    tokens = F.col("output") + F.col("reasoning")
    used = live & ~timed & (F.col("_gap") <= live_s)
    out = e.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"), F.sum(F.when(live & timed, F.col("output"))).alias("_t_out"), F.sum(F.when(live & timed, F.col("decode_ms"))).alias("_t_ms"),
        F.sum(F.when(used, tokens)).alias("_out"), F.sum(F.when(used, F.greatest(F.col("_gap"), tokens / fastest))).alias("_secs"))
    rate = F.when((F.col("_t_ms") > 0) & (F.col("_t_out") > 0), F.col("_t_out") / (F.col("_t_ms") / 1000)).when(
        (F.col("_secs") >= 1) & (F.col("_out") > 0), F.col("_out") / F.col("_secs")).otherwise(0.0)
    return out.select(*by, "requests", F.round(rate, 6).alias("rate"))


def balance_use(readings: DataFrame, by: Sequence[str], at: str, balance: str) -> DataFrame:
    """Use per account and day from balance readings: the drop within the day plus the drop overnight; rises are top-ups and add nothing."""
    day = readings.groupBy(*by, F.to_date(at).alias("day")).agg(F.min_by(balance, at).alias("first"), F.max_by(balance, at).alias("last"))
    w = Window.partitionBy(*by).orderBy("day")
    within = F.greatest(F.col("first") - F.col("last"), F.lit(0.0))
    overnight = F.greatest(F.coalesce(F.lag("last").over(w) - F.col("first"), F.lit(0.0)), F.lit(0.0))
    return day.withColumn("used", F.round(within + overnight, 6))
