"""All registered queries of the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyforge.plans import prep, usage

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (usage, prep)


def queries() -> dict[str, Query]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLE.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking of models over canonical facts, with the root sessions that used them."""
    return queries()["by_model"](spark, sf_dir)
