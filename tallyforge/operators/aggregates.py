"""Totals, rankings and rollups over canonical events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.scalars import hit_rate, total
from tallyforge.schema import SESSION_KEY, TOKENS


def measures() -> list[Column]:
    """Sums of the token classes, cost, requests and unpriced requests of raw events."""
    return [*[F.sum(t).alias(t) for t in TOKENS], F.round(F.sum("cost"), 6).alias("cost"), F.count(F.lit(1)).alias("requests"),
            F.count_if(~F.col("priced")).alias("unpriced")]


def _rooted(events: DataFrame, tree: DataFrame, *key: str) -> DataFrame:
    """Sums per session and key with the root of each session. Events are summed before they meet the tree, so a session with
    a third of all events is a few rows in the join."""
    per = events.groupBy(*SESSION_KEY, *key).agg(*measures())
    return per.join(tree.select(*SESSION_KEY, "root_id"), list(SESSION_KEY), "left").withColumn("root_id", F.coalesce("root_id", "session_id"))


def _resum() -> list[Column]:
    return [*[F.sum(t).alias(t) for t in TOKENS], F.round(F.sum("cost"), 6).alias("cost"), F.sum("requests").alias("requests"), F.sum("unpriced").alias("unpriced"),
            F.count_distinct("harness", "instance_id", "root_id").alias("sessions")]


def totals(events: DataFrame, tree: DataFrame) -> DataFrame:
    """One row: sums, distinct root sessions (a session nobody describes is its own root), share of the prompt read from the cache."""
    out = _rooted(events, tree).agg(*_resum())
    return out.fillna(0).withColumn("cache_hit", F.round(hit_rate(F.col("cache_read"), F.col("input"), F.col("cache_write")), 6))


def ranking(events: DataFrame, tree: DataFrame, *key: str) -> DataFrame:
    """Sums per key, the largest token total first."""
    return _rooted(events, tree, *[k for k in key if k not in SESSION_KEY]).groupBy(*key).agg(*_resum()).withColumn("total", total()).orderBy(F.desc("total"), *key)


def usage(events: DataFrame, unit: str = "DAY") -> DataFrame:
    """Sparse sums per day or hour, tool, model and provider."""
    return events.groupBy(F.date_trunc(unit, "ts").alias("bucket"), "harness", "model", "resolved_provider").agg(*measures())


ROLLUP_KEY = ("harness", "instance_id", "session_id", "resolved_provider", "model", "project")


def day_rollup(events: DataFrame, *extra: str) -> DataFrame:
    """Pre-aggregated day rows: the key of the read API plus any extra columns (such as the endpoint)."""
    return events.groupBy(F.to_date("ts").alias("day"), *ROLLUP_KEY, *extra).agg(*measures())


def from_rollup(rollup: DataFrame, *key: str) -> DataFrame:
    """Sums of rollup rows per key: equal to the sums of the events behind them."""
    return rollup.groupBy(*key).agg(*[F.sum(t).alias(t) for t in TOKENS], F.round(F.sum("cost"), 6).alias("cost"), F.sum("requests").alias("requests"), F.sum("unpriced").alias("unpriced"))


def rollup_with_edges(rollup: DataFrame, events: DataFrame, start: Column, end: Column) -> DataFrame:
    """Rows for [start, end): whole days from the rollup, the two days the ends cut through from the events."""
    first, last = F.to_date(F.timestamp_micros(F.unix_micros(start) + 86_399_999_999)), F.to_date(end)
    whole = rollup.where((F.col("day") >= first) & (F.col("day") < last))
    cut = events.where((F.col("ts") >= start) & (F.col("ts") < end)).where((F.to_date("ts") < first) | (F.to_date("ts") >= last))
    return whole.unionByName(day_rollup(cut))


def refresh_days(rollup: DataFrame, events: DataFrame, touched: DataFrame) -> DataFrame:
    """Incremental maintenance: rollup rows of the touched days are recomputed, days left without requests vanish."""
    days = touched.select("day").distinct()
    again = events.withColumn("day", F.to_date("ts")).join(days, "day", "left_semi").drop("day")
    return rollup.join(days, "day", "left_anti").unionByName(day_rollup(again))


def unpriced_models(events: DataFrame) -> DataFrame:
    """Requests and tokens without a price per model and provider, the largest first."""
    out = events.where(~F.col("priced")).groupBy("model", "resolved_provider").agg(F.count(F.lit(1)).alias("requests"), F.sum(total()).alias("tokens"))
    return out.orderBy(F.desc("tokens"), "model", "resolved_provider")


def provider_groups(events: DataFrame) -> DataFrame:
    """One row per endpoint identity: sums and the distinct members (provider and address) behind it, sorted."""
    member = F.concat_ws(" ", "resolved_provider", "base_url")
    return events.groupBy("provider_id").agg(*measures(), F.array_join(F.array_sort(F.collect_set(member)), ", ").alias("members"), F.min("resolved_provider").alias("label"))


def envelope(events: DataFrame, *groups: str) -> DataFrame:
    """Grand total and one ranking per group column in a single pass over the events (grouping sets)."""
    sets = [[g] for g in groups] + [[]]
    marks = sum((F.grouping(g).cast("int") * (1 << k) for k, g in enumerate(groups)), F.lit(0))
    out = events.groupingSets([[F.col(c) for c in s] for s in sets], *groups).agg(*measures(), marks.alias("grouping"), F.max("ts").alias("freshest"))
    return out
