"""Continuous ingest: micro-batches are merged into a fact table that is replaced version by version."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.merge import VALID, first_inserts, upsert_facts
from tallyforge.schema import KEY


class FactStore:
    """Facts as a merged base and the batches since, all Parquet under one folder; a pointer file names what counts.

    A commit writes the batch alone and publishes it by one atomic rename of the pointer, so its cost follows the batch, not
    the table, readers see all of a batch or nothing, and a batch that is delivered again changes nothing. After
    ``compact_every`` batches the merge is written as a new base.
    """

    def __init__(self, spark: SparkSession, folder: str, sequence: str = "delivery_id", compact_every: int = 16) -> None:
        self.spark, self.folder, self.sequence, self.compact_every = spark, folder.rstrip("/"), sequence, compact_every
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._fs.Path(f"{self.folder}/{name}")

    def _pointer(self) -> dict:
        path = self._path("CURRENT")
        fs = path.getFileSystem(self._conf)
        if not fs.exists(path):
            return {"batch": -1, "parts": []}
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, pointer: dict) -> None:
        """Writes the new pointer beside the current one and renames it over it, on whatever file system the folder is."""
        new, now = self._path("NEXT"), self._path("CURRENT")
        stream = new.getFileSystem(self._conf).create(new, True)
        stream.write(bytearray(json.dumps(pointer).encode()))
        stream.close()
        over = self.spark._jvm.java.lang.reflect.Array.newInstance(self._fs.Options.Rename.OVERWRITE.getClass(), 1)
        self.spark._jvm.java.lang.reflect.Array.set(over, 0, self._fs.Options.Rename.OVERWRITE)
        context = self._fs.FileContext.getFileContext(new.getFileSystem(self._conf).getUri(), self._conf)
        context.rename(self._fs.Path(f"{self.folder}/NEXT"), now, over)

    def _rows(self) -> DataFrame | None:
        parts = self._pointer()["parts"]
        return self.spark.read.option("mergeSchema", "true").parquet(*parts) if parts else None

    def current(self) -> DataFrame | None:
        """One row per key, merged as they are read."""
        rows = self._rows()
        return upsert_facts(rows, self.sequence) if rows is not None else None

    def commit(self, batch: DataFrame, batch_id: int) -> int:
        """Adds a batch and returns how many keys are new; a batch number that was committed before is skipped."""
        at = self._pointer()
        if batch_id <= at["batch"]:
            return 0
        fine = batch.where(VALID)
        stored = self._rows()
        new = (first_inserts(fine, stored) if stored is not None else fine.dropDuplicates(list(KEY))).count()
        path = f"{self.folder}/batch-{batch_id:012d}"
        fine.write.mode("overwrite").parquet(path)
        self._publish({"batch": batch_id, "parts": [*at["parts"], path]})
        if len(at["parts"]) >= self.compact_every:
            self.compact()
        return new

    def compact(self) -> None:
        """Writes the merge of all parts as the new base."""
        at, rows = self._pointer(), self.current()
        if rows is not None:
            path = f"{self.folder}/base-{at['batch']:012d}"
            rows.write.mode("overwrite").parquet(path)
            self._publish({"batch": at["batch"], "parts": [path]})


def run_ingest(stream: DataFrame, store: FactStore, checkpoint: str, report: Callable[[int, int], None] | None = None, available_now: bool = True):
    """Streaming query that commits every micro-batch to the store; ``report`` hears (batch, new keys)."""
    def each(batch: DataFrame, batch_id: int) -> None:
        n = store.commit(batch, batch_id)
        if report:
            report(batch_id, n)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def eligible(events: DataFrame, commit, span_s: int = 60) -> DataFrame:
    """Events whose own time lies in (commit - span, commit]: only these feed the live rate."""
    return events.where((F.col("ts") > commit - F.expr(f"interval {span_s} seconds")) & (F.col("ts") <= commit))
