"""Stored tables behind the read queries: facts, sessions, their tree, and day rollups that know the roots.

What a read needs is worked out when facts change, not when they are read: the merge of deliveries, the session tree, and sums
per day. A read of whole days touches rollups only; a range that cuts through days adds those two days from the facts.
All tables are Parquet by day, so a range prunes files, and are cached in as few partitions as their rows need: small
ones are one task without a shuffle, large ones spread.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.scalars import hit_rate, total
from tallyforge.operators import aggregates as A
from tallyforge.operators import sessions as H
from tallyforge.schema import SESSION_KEY, TOKENS

_ROWS = 1_000_000  # rows of a cached table per partition
_SUMS = (*TOKENS, "cost", "requests", "unpriced")
_DAY = timedelta(days=1)


def _resum() -> list:
    return [F.round(F.sum(c), 6).alias(c) if c == "cost" else F.sum(c).alias(c) for c in _SUMS]


class Serving:
    """Read queries over tables that ``build`` wrote to a folder."""

    def __init__(self, spark: SparkSession, folder: str, cached: bool = True) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.facts, self.rollup, self.closure_days, self.meta, self.tree = (
            self._table(n, cached) for n in ("facts", "rollup", "closure_days", "meta", "tree"))

    def _table(self, name: str, cached: bool) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}")
        if not cached:
            return df
        out = df.coalesce(max(1, df.count() // _ROWS)).cache()
        out.count()
        return out

    @staticmethod
    def build(events: DataFrame, meta: DataFrame, folder: str) -> None:
        """Writes facts, sessions, their tree, the day rollup with roots, and day sums per session with its descendants."""
        spark, folder = events.sparkSession, folder.rstrip("/")
        events.withColumn("day", F.to_date("ts")).write.mode("overwrite").partitionBy("day").parquet(f"{folder}/facts")
        meta.write.mode("overwrite").parquet(f"{folder}/meta")
        H.session_tree(meta).write.mode("overwrite").parquet(f"{folder}/tree")
        facts, tree = spark.read.parquet(f"{folder}/facts"), spark.read.parquet(f"{folder}/tree")
        Serving._with_roots(A.day_rollup(facts.drop("day")), tree).write.mode("overwrite").partitionBy("day").parquet(f"{folder}/rollup")
        rollup = spark.read.parquet(f"{folder}/rollup")
        own = rollup.groupBy("day", *SESSION_KEY).agg(*_resum())
        up = tree.select(*SESSION_KEY, F.explode("path").alias("ancestor"))
        every = own.join(up, list(SESSION_KEY)).groupBy("day", "harness", "instance_id", F.col("ancestor").alias("session_id")).agg(*_resum())
        every.write.mode("overwrite").partitionBy("day").parquet(f"{folder}/closure_days")

    @staticmethod
    def _with_roots(rollup: DataFrame, tree: DataFrame) -> DataFrame:
        out = rollup.join(tree.select(*SESSION_KEY, "root_id"), list(SESSION_KEY), "left")
        return out.withColumn("root_id", F.coalesce("root_id", "session_id"))

    def _cut(self, start: datetime, end: datetime) -> DataFrame | None:
        """Facts of the days that the ends cut through; None if both ends are midnights."""
        day = lambda t: t.astimezone(timezone.utc).replace(hour=0, minute=0, second=0, microsecond=0)
        edges = {day(t).date() for t in (start, end) if day(t) != t.astimezone(timezone.utc)}
        if not edges:
            return None
        return self.facts.where(F.col("day").isin(*sorted(edges)) & (F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end)))

    def _whole(self, table: DataFrame, start: datetime, end: datetime) -> DataFrame:
        a, b = (t.astimezone(timezone.utc) for t in (start, end))
        first = (a if a.time() == datetime.min.time() else a + _DAY).date()
        return table.where((F.col("day") >= F.lit(first)) & (F.col("day") < F.lit(b.date())))

    def rows(self, start: datetime, end: datetime) -> DataFrame:
        """Rollup rows of [start, end)."""
        whole, cut = self._whole(self.rollup, start, end), self._cut(start, end)
        return whole if cut is None else whole.unionByName(self._with_roots(A.day_rollup(cut.drop("day")), self.tree).select(*whole.columns))

    def totals(self, start: datetime, end: datetime) -> DataFrame:
        out = self.rows(start, end).groupBy("harness", "instance_id", "root_id").agg(*_resum())
        out = out.agg(*_resum(), F.count(F.lit(1)).alias("sessions")).fillna(0)
        return out.withColumn("cache_hit", F.round(hit_rate(F.col("cache_read"), F.col("input"), F.col("cache_write")), 6))

    def ranking(self, start: datetime, end: datetime, *key: str) -> DataFrame:
        per = self.rows(start, end).groupBy(*dict.fromkeys([*key, "harness", "instance_id", "root_id"])).agg(*_resum())
        return per.groupBy(*key).agg(*_resum(), F.count(F.lit(1)).alias("sessions")).withColumn("total", total()).orderBy(F.desc("total"), *key)

    def daily(self, start: datetime, end: datetime) -> DataFrame:
        """Sums of every day of the range that has requests."""
        return self.rows(start, end).groupBy("day").agg(*_resum()).orderBy("day")

    def sessions(self, start: datetime, end: datetime, order: str = "recent", limit: int = 50) -> DataFrame:
        """Root sessions with requests in the range, summed over their descendants."""
        whole, cut = self._whole(self.closure_days, start, end), self._cut(start, end)
        per = whole.groupBy(*SESSION_KEY).agg(*_resum())
        if cut is not None:
            per = per.unionByName(H.rolled_up(cut, self.tree).select(*per.columns)).groupBy(*SESSION_KEY).agg(*_resum())
        out = self.meta.where("parent_id = ''").join(per.where("requests > 0"), list(SESSION_KEY)).withColumn("total", total())
        first = {"recent": F.desc("updated_at"), "tokens": F.desc("total"), "cost": F.desc("cost")}[order]
        return out.orderBy(first, "harness", "session_id", "instance_id").limit(limit)


@contextmanager
def one_stage(spark: SparkSession) -> Iterator[None]:
    """Settings for reads of cached tables of one partition: no exchange, no broadcast job, no re-planning."""
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "1", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
