"""Input tables to canonical events and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.scalars import resolved_provider
from tallyforge.operators.merge import fold_sessions, parent_stubs, upsert_facts
from tallyforge.runtime import blank_to_null, instance_or_default, table
from tallyforge.schema import SESSION_KEY

_TEXT = ("dedup_key", "session_id", "project", "model", "provider", "base_url", "request_id", "boundary", "bill_unit", "git_branch")
_COUNTS = ("input", "output", "cache_read", "cache_write", "cache_write_1h", "reasoning", "decode_ms")


def deliveries(spark: SparkSession, sf: str) -> DataFrame:
    """Delivered usage events with canonical null rules, not merged yet."""
    raw = table(spark, sf, "usage_events")
    return raw.select(
        "delivery_id", "received_at", F.coalesce("harness", F.lit("")).alias("harness"), instance_or_default().alias("instance_id"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in _TEXT], F.coalesce(blank_to_null("parent_id"), F.lit("")).alias("parent_id"), "ts",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in _COUNTS], "log_cost", "bill_amount")


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical events, one per key, with provider, cost and whether they are priced (by their log)."""
    up = upsert_facts(deliveries(spark, sf).drop("received_at"), "delivery_id")
    return up.withColumns({
        "resolved_provider": resolved_provider("provider", "base_url", "model"), "cost": F.coalesce("log_cost", F.lit(0.0)), "priced": F.col("log_cost").isNotNull()})


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Session metadata: what the tools' session rows state, else what the events of a session state; parents without either get a stub."""
    raw = table(spark, sf, "session_meta")
    own = fold_sessions(raw.select(F.coalesce("harness", F.lit("")).alias("harness"), instance_or_default().alias("instance_id"), "session_id",
                                   F.trim("parent_id").alias("parent_id"), "title", "project", "started_at", "updated_at"), "updated_at")
    ev = deliveries(spark, sf).where("session_id <> ''")
    seen = fold_sessions(ev.select(*SESSION_KEY, "parent_id", F.lit("").alias("title"), "project", F.col("ts").alias("started_at"), F.col("ts").alias("updated_at"), "delivery_id"), "delivery_id")
    stubs = parent_stubs(seen.select(*SESSION_KEY, "parent_id")).union(parent_stubs(own)).distinct()
    both = own.withColumn("_rank", F.lit(1)).unionByName(seen.withColumn("_rank", F.lit(0))).unionByName(stubs.withColumn("_rank", F.lit(-1)), allowMissingColumns=True)
    return fold_sessions(both, "_rank")
