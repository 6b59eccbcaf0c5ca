"""Session helpers: tables by directory, reliable checkpoints, plan barriers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once per application, unless their PYTHONPATH has it."""
    root = Path(__file__).resolve().parent.parent
    sc = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_tallyforge_shipped", False):
        return
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="tallyforge-"), "tallyforge"), "zip", root, "tallyforge")
    sc.addPyFile(made)
    sc._tallyforge_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; zone-less timestamps become instants under the UTC session zone."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session that names none (tests)
    gets a folder of its own, removed when it ends; elsewhere a folder of one machine would lose rows with it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="tallyforge-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows written once as a table in the shared folder and read back, so they survive lost executors.

    A table has the size that its files have. A checkpoint keeps the estimate of the plan it came from, and in a loop of
    self-joins that estimate squares every round until planning takes longer than the work. Tables go when the session ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


#: characters that are white space, made from their Unicode property
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def blank_to_null(c: Column | str) -> Column:
    """Text without surrounding white space (any Unicode blank); empty text becomes null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.btrim(c.cast("string"), F.lit(BLANKS)), F.lit(""))


def instance_or_default(c: Column | str = "instance_id") -> Column:
    """A blank instance is the instance ``default``."""
    return F.coalesce(blank_to_null(c), F.lit("default"))


def identifier(c: Column | str) -> Column:
    """Identifier with letter case and surrounding white space removed; blank is null."""
    return F.lower(blank_to_null(c))


def staged(df: DataFrame, **made: Column) -> DataFrame:
    """Adds computed columns behind a generator of one row.

    Later filters and projections refer to the results: unlike ``withColumn``, the optimiser cannot put the
    expressions into every place that uses them, which blows up plans whose steps build on each other.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names that clash with none of the frame's columns, derived from the wanted ones."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


@contextmanager
def interactive(spark: SparkSession) -> Iterator[None]:
    """Settings for reads of a few thousand cached rows, where re-planning and spare tasks cost more than they save."""
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def default_spark(app: str = "tallyforge", cpus: str | None = None) -> SparkSession:
    """Local session for tests and the benchmark."""
    n = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{n}]").appName(app)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", n).config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
