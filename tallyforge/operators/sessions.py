"""Session trees: roll-up to every ancestor, children, pages, details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.scalars import total
from tallyforge.operators.aggregates import measures
from tallyforge.operators.hierarchy import hierarchy
from tallyforge.runtime import cut
from tallyforge.schema import SESSION_KEY, TOKENS


def _scope() -> Column:
    return F.to_json(F.array("harness", "instance_id"))


def session_tree(meta: DataFrame) -> DataFrame:
    """Hierarchy of sessions from their metadata: ``harness, instance_id, session_id, root_id, depth, path``.

    The root is the highest ancestor; a parent without metadata counts as a session. On loops the walk
    of a session ends before it would repeat: the session is its own root.
    """
    tree = hierarchy(meta.select(_scope().alias("scope"), F.col("session_id").alias("node"), F.col("parent_id").alias("parent")), paths=True)
    part = F.from_json("scope", "array<string>")
    return tree.select(part[0].alias("harness"), part[1].alias("instance_id"), F.col("node").alias("session_id"),
                       F.when(F.col("depth") < 0, F.col("node")).otherwise(F.col("root")).alias("root_id"), "depth",
                       F.coalesce("path", F.array("node")).alias("path"))


def rolled_up(events: DataFrame, tree: DataFrame) -> DataFrame:
    """Sums per session over its own events and those of all its descendants.

    Events are summed per session first, so the closure multiplies sessions by their depth, never events.
    """
    own = events.groupBy(*SESSION_KEY).agg(*measures())
    up = tree.select(*SESSION_KEY, F.explode("path").alias("ancestor"))
    every = own.join(up, list(SESSION_KEY)).groupBy("harness", "instance_id", F.col("ancestor").alias("session_id"))
    return every.agg(*[F.sum(t).alias(t) for t in TOKENS], F.round(F.sum("cost"), 6).alias("cost"), F.sum("requests").alias("requests"), F.sum("unpriced").alias("unpriced"))


def session_rows(events: DataFrame, meta: DataFrame) -> DataFrame:
    """Metadata, rolled-up sums and number of direct children of every session."""
    tree = cut(session_tree(meta))
    kids = meta.where("parent_id <> ''").groupBy("harness", "instance_id", F.col("parent_id").alias("session_id")).agg(F.count(F.lit(1)).alias("children"))
    sums = rolled_up(events, tree)
    out = meta.join(sums, list(SESSION_KEY), "left").join(kids, list(SESSION_KEY), "left")
    return out.fillna(0, [*TOKENS, "cost", "requests", "unpriced", "children"]).withColumn("total", total())


def page(rows: DataFrame, order: str = "recent", limit: int = 0, offset: int = 0) -> DataFrame:
    """Root sessions with requests in the wanted order, with the number of all of them in ``of_total``.

    ``limit`` 0 or less means all, a negative ``offset`` is 0. Ties go by tool, session and instance.
    """
    first = {"recent": F.desc("updated_at"), "tokens": F.desc("total"), "cost": F.desc("cost")}[order]
    roots = rows.where("parent_id = '' and requests > 0")
    out = roots.orderBy(first, "harness", "session_id", "instance_id").offset(max(offset, 0))
    return (out.limit(limit) if limit > 0 else out).withColumn("of_total", roots.agg(F.count(F.lit(1))).scalar())


def breakdown(events: DataFrame, tree: DataFrame) -> DataFrame:
    """Sums per session, provider and model over the session and its descendants, largest total first."""
    own = events.groupBy(*SESSION_KEY, "resolved_provider", "model").agg(*measures())
    up = tree.select(*SESSION_KEY, F.explode("path").alias("ancestor"))
    every = own.join(up, list(SESSION_KEY)).groupBy("harness", "instance_id", F.col("ancestor").alias("session_id"), "resolved_provider", "model")
    return every.agg(*[F.sum(t).alias(t) for t in TOKENS], F.round(F.sum("cost"), 6).alias("cost"), F.sum("requests").alias("requests")).withColumn("total", total())


def detail(events: DataFrame, meta: DataFrame, harness: str, session_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(row with descendants, direct children, own events in order) of one session; raises if several instances have it."""
    instances = [r[0] for r in meta.where((F.col("harness") == harness) & (F.col("session_id") == session_id)).select("instance_id").distinct().limit(2).collect()]
    if len(instances) > 1:
        raise ValueError(f"session {session_id} of {harness} exists in several instances")
    mine = (F.col("harness") == harness) & (F.col("instance_id") == (instances[0] if instances else "default"))
    rows = session_rows(events.where(mine), meta.where(mine))
    own = events.where(mine & (F.col("session_id") == session_id)).orderBy("ts", "dedup_key")
    wide = rows.where(F.col("session_id") == session_id).withColumns({
        "started_at": F.least("started_at", own.agg(F.min("ts")).scalar()), "updated_at": F.greatest("updated_at", own.agg(F.max("ts")).scalar())})
    return wide, rows.where(F.col("parent_id") == session_id).orderBy(F.desc("updated_at"), "session_id"), own
