"""Raw inputs: complete lines and whole JSON documents of text logs, query results of SQLite files.

Every file is one row of Spark's ``binaryFile`` source, so files are spread over tasks and nothing needs a local path.
"""

from __future__ import annotations

import io
import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.runtime import ship
from tallyforge.sources.wal import with_log

_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
_ZSTD = b"\x28\xb5\x2f\xfd"


def inflate(data: bytes) -> bytes:
    """Content of a file; of a zstd stream that is cut off all that can be read."""
    if not data.startswith(_ZSTD):
        return data
    import zstandard

    out = io.BytesIO()
    try:
        with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True) as r:
            while chunk := r.read(1 << 20):
                out.write(chunk)
    except zstandard.ZstdError:
        pass
    return out.getvalue()


def _files(spark: SparkSession, path: str | list[str], glob: str | None) -> DataFrame:
    ship(spark)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.load(path).select(F.col("path").alias("source_path"), "content")


def read_lines(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """``source_path, line_no, line`` of all complete lines; a last line without its line feed is still being written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines = inflate(raw).decode("utf-8", "replace").split("\n")[:-1]
                for a in range(0, len(lines), 10_000):
                    part = [x.rstrip("\r") for x in lines[a:a + 10_000]]
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(part)), pa.array(range(a + 1, a + 1 + len(part)), pa.int64()), pa.array(part, pa.string())], names=["source_path", "line_no", "line"])

    return _files(spark, path, glob).mapInArrow(run, "source_path string, line_no bigint, line string")


def read_documents(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """``source_path, line`` of whole files, for logs that are one JSON document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [inflate(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["source_path", "line"])

    return _files(spark, path, glob).mapInArrow(run, "source_path string, line string")


_SIDE = r"-(wal|shm|journal)$"  # files beside a database


def _databases(spark: SparkSession, path: str | list[str], glob: str | None) -> DataFrame:
    """``source_path, content, log`` of every database, with the write-ahead log that lies beside it."""
    files = _files(spark, path, glob).where(~F.col("source_path").rlike(_SIDE))
    conf, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    folders = []
    for one in [path] if isinstance(path, str) else path:
        here = jvm.org.apache.hadoop.fs.Path(one)
        fs = here.getFileSystem(conf)
        if fs.exists(here) and fs.getFileStatus(here).isFile():  # a single file: its log is named, not searched
            beside = jvm.org.apache.hadoop.fs.Path(one + "-wal")
            folders += [one + "-wal"] if fs.exists(beside) else []
        else:
            folders.append(one)
    if not folders:
        return files.withColumn("log", F.lit(None).cast("binary"))
    logs = _files(spark, folders, (glob or "*") + "-wal").select(F.regexp_replace("source_path", "-wal$", "").alias("source_path"), F.col("content").alias("log"))
    return files.join(logs, "source_path", "left")


def _query(raw: bytes, log: bytes | None, table: str, columns: list[str]) -> Iterator[list[tuple]]:
    """Blocks of rows of a table, its rowid first; raises ``sqlite3.DatabaseError`` if the file is none."""
    con = sqlite3.connect(":memory:")
    try:
        con.deserialize(with_log(raw, log))
        have = {r[1] for r in con.execute(f'PRAGMA table_info("{table}")')}
        if have:
            picked = ", ".join(["rowid", *(f'"{c}"' if c in have else "NULL" for c in columns)])
            cursor = con.execute(f'SELECT {picked} FROM "{table}" ORDER BY rowid')
            while rows := cursor.fetchmany(10_000):
                yield rows
    finally:
        con.close()


def read_sqlite(spark: SparkSession, path: str | list[str], table: str, columns: dict[str, str], glob: str | None = None) -> DataFrame:
    """Rows of one table of every SQLite file: ``source_path, rowid`` and the wanted columns with their Spark types.

    Transactions that are committed but still in a write-ahead log (``-wal``) count. Columns and tables that a file does not have
    are null or empty; rows up to the place where a file is damaged are kept, and ``sqlite_outcomes`` reports it.
    Numbers that SQLite holds as text are cast where they can be.
    """
    schema = "source_path string, rowid bigint, " + ", ".join(f"`{c}` {t}" for c, t in columns.items())

    def value(v: object, kind: str) -> object:
        if v is None:
            return None
        try:
            if kind == "binary":
                return v if isinstance(v, bytes) else str(v).encode()
            return int(float(v)) if kind == "bigint" else float(v) if kind == "double" else v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)
        except (TypeError, ValueError, OverflowError):
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, raw, log in zip(*(batch.column(k).to_pylist() for k in range(3))):
                blocks = _query(raw, log, table, list(columns))
                while True:
                    try:
                        rows = next(blocks, None)
                    except sqlite3.DatabaseError:
                        rows = None
                    if rows is None:
                        break
                    cols = [pa.array([value(r[k], t) for r in rows], _ARROW[t]) for k, t in enumerate(columns.values(), 1)]
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), *cols], names=["source_path", "rowid", *columns])

    return _databases(spark, path, glob).mapInArrow(run, schema)


def sqlite_outcomes(spark: SparkSession, path: str | list[str], table: str, glob: str | None = None) -> DataFrame:
    """``source_path, reason, rows`` of every file: ``ok``, ``empty``, ``unsupported_schema`` (no such table), ``partial`` (damaged after some
    rows) or ``corrupt``, for ``sinks.diagnose``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p, raw, log in zip(*(batch.column(k).to_pylist() for k in range(3))):
                n = 0
                try:
                    for rows in _query(raw, log, table, []):
                        n += len(rows)
                    there = n or any(r[1] == table for rows in _query(raw, log, "sqlite_master", ["name"]) for r in rows)
                    out.append((p, "ok" if n else "empty" if there else "unsupported_schema", n))
                except sqlite3.DatabaseError:
                    out.append((p, "partial" if n else "corrupt", n))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((), (), ()), (pa.string(), pa.string(), pa.int64()))], names=["source_path", "reason", "rows"])

    return _databases(spark, path, glob).mapInArrow(run, "source_path string, reason string, rows bigint")
