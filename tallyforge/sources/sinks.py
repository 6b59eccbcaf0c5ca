"""Outputs: session export, ingest diagnostics, atomic table replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: columns of the session export
EXPORT = ("harness", "instance_id", "session_id", "title", "project", "started_at", "updated_at", "requests", "input", "output", "cache_read", "cache_write", "cost", "models")

# fixed values: outcomes of reading a source, the most serious first
REASONS = ("permission_denied", "corrupt", "read_error", "locked", "unsupported_schema", "partial", "empty", "ok")


def session_export(rows: DataFrame, breakdown: DataFrame) -> DataFrame:
    """One line per root session with requests: metadata, rolled-up sums and the names of its models, sorted and joined by blanks."""
    key = ["harness", "instance_id", "session_id"]
    models = breakdown.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("model")), " ").alias("models"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c)
    out = rows.where("parent_id = '' and requests > 0").join(models, key, "left")
    return out.select(*[stamp(c) if c in ("started_at", "updated_at") else F.col(c) for c in EXPORT])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def diagnose(outcomes: DataFrame) -> DataFrame:
    """Outcome per instance from ``harness, instance_id, source_path, reason``: the most serious reason of its sources; ``ok`` only if
    every source was read and at least one held something."""
    rank: Column = F.array_position(F.array(*[F.lit(r) for r in REASONS]), F.col("reason"))
    rank = F.when(rank > 0, rank).otherwise(REASONS.index("read_error") + 1)
    worst = outcomes.groupBy("harness", "instance_id").agg(
        F.min(F.when(F.col("reason") == "empty", None).otherwise(rank)).alias("_w"), F.count(F.lit(1)).alias("sources"), F.count_if(F.col("reason") == "ok").alias("good"))
    name = F.element_at(F.array(*[F.lit(r) for r in REASONS]), F.coalesce(F.col("_w"), F.lit(REASONS.index("empty") + 1)).cast("int"))
    return worst.select("harness", "instance_id", "sources", "good", name.alias("reason"))
