"""Problem 1: messages delivered more than once.

Method: identifiers are split by their aggregated frequency. One aggregation counts the occurrences of every
identifier (its 64-bit hash, so a hot one is one row per map task and a row is a few bytes). Those seen once need
no further work and their deliveries pass; only deliveries of repeated identifiers are read again, ranked within
their request and united with the singletons. Two identifiers that share a hash are both kept as repeated and told
apart when they are ranked, so the split loses nothing.

A delivery is named by its dedup key, or by its request id if it has no key. A request id links
its deliveries only if one of them lacks a key; such links can chain several keys into one request,
so they are closed transitively (connected components over the linked identifiers alone, a small
share of the rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.components import connected_components
from tallyforge.runtime import cut, fresh, identifier, instance_or_default

_SEP = "\x1f"


def _named(df: DataFrame, order: str) -> DataFrame:
    """Slim rows ``(ord, scope, dk, rid)`` with unified identifiers; scope is harness and instance."""
    return df.select(
        F.col(order).alias("ord"),
        F.concat_ws(_SEP, F.coalesce("harness", F.lit("")), instance_or_default()).alias("scope"),
        identifier("dedup_key").alias("dk"), identifier("request_id").alias("rid"),
    )


def _occurrences(slim: DataFrame, *extra: str) -> DataFrame:
    """One row per identifier of every delivery: ``(h, links)`` with the hash of the identifier and whether it names
    the delivery, which is what makes it link others."""
    of_key = F.struct(F.xxhash64("scope", F.lit("k"), "dk").alias("h"), F.lit(True).alias("links"), F.col("dk").isNotNull().alias("there"),
                      *([F.concat(F.lit("k"), "dk").alias("name"), F.concat(F.lit("r"), "rid").alias("mate")] if extra else []))
    of_request = F.struct(F.xxhash64("scope", F.lit("r"), "rid").alias("h"), F.col("dk").isNull().alias("links"), F.col("rid").isNotNull().alias("there"),
                          *([F.concat(F.lit("r"), "rid").alias("name"), F.lit(None).cast("string").alias("mate")] if extra else []))
    return slim.select(*extra, F.inline(F.array(of_key, of_request))).where("there").drop("there")


#: repeated identifiers that are broadcast (8 bytes each); more of them are joined by shuffle
BROADCAST_KEYS = 400_000
#: an identifier with more than one in so many of the occurrences is spread over as many tasks; there are fewer than this number
HOT_SHARE = 1_000
_SALTS = 64


def _with_repeated(rows: DataFrame, keys: DataFrame, on: list[str], weight: str, broadcast_keys: int) -> DataFrame:
    """Equi-join of ``rows`` with ``keys`` (unique on ``on``, ``weight`` rows each).

    Counted keys within ``broadcast_keys`` are broadcast. Others are shuffled, and those that hold more than one in
    ``HOT_SHARE`` rows are salted over ``_SALTS`` tasks: fewer than ``HOT_SHARE`` keys can be so frequent, so the list that tells them is bounded.
    """
    if keys.count() <= broadcast_keys:
        return rows.join(F.broadcast(keys), on)
    hot = keys.where(F.col(weight) * HOT_SHARE > F.lit(keys.agg(F.sum(weight)).first()[0])).select(*on, F.lit(_SALTS).alias("_salts"))
    salts = F.coalesce("_salts", F.lit(1))
    spread = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", F.pmod(F.xxhash64("ord"), salts).cast("int")).drop("_salts")
    copies = keys.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return spread.join(copies, [*on, "_salt"]).drop("_salt")


def _repeated(slim: DataFrame) -> DataFrame:
    """``(h, copies)`` of the identifiers that occur more than once and link what they occur in."""
    return _occurrences(slim).groupBy("h").agg(F.count(F.lit(1)).alias("copies"), F.max("links").alias("links")).where("copies > 1 and links").drop("links")


def _ranked(slim: DataFrame, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``(ord, first)`` of all deliveries that share a repeated identifier, with the lowest ``ord`` of their request."""
    repeated = cut(_repeated(slim))
    found = cut(_with_repeated(_occurrences(slim, "ord", "scope"), repeated, ["h"], "copies", broadcast_keys).select("ord", "scope", "name", "mate"))
    chains = found.where("mate is not null").select("scope", "name", "mate").join(
        found.where("name like 'r%'").select("scope", F.col("name").alias("mate")).distinct(), ["scope", "mate"])
    node = lambda c: F.concat_ws(_SEP, "scope", c)
    part = F.split("node", _SEP, 3)
    labels = cut(connected_components(cut(chains.select(node("name").alias("src"), node("mate").alias("dst")).distinct())).select(
        F.concat_ws(_SEP, part[0], part[1]).alias("scope"), part[2].alias("name"), "component"))
    # rank 1 of a request is the minimum of the arrival order, which partial aggregation finds however large the group
    firsts = found.groupBy("scope", "name").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("copies")).join(labels, ["scope", "name"], "left")
    chained = firsts.where("component is not null").groupBy("component").agg(F.min("first").alias("first"))
    whole = firsts.where("component is null").select("scope", "name", "first", "copies").unionByName(
        firsts.where("component is not null").drop("first").join(chained, "component").select("scope", "name", "first", "copies"))
    return _with_repeated(found, cut(whole), ["scope", "name"], "copies", broadcast_keys).select("ord", "first")


def dropped_deliveries(df: DataFrame, order: str = "delivery_id", broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``order`` values of all deliveries that are not the first of their request.

    Null or blank identifiers equal nothing; a row without both is never dropped. A row repeated
    with the same ``order`` value is the same delivery and is kept or dropped as one. Rows whose
    ``order`` is null have no place in the order and are not reported. ``broadcast_keys`` only chooses how repeated
    identifiers meet their deliveries.
    """
    slim = _named(df, order).where("ord is not null")
    return _ranked(slim, broadcast_keys).where("ord > first").select(F.col("ord").alias(order)).distinct()


def keep_once(df: DataFrame, order: str = "delivery_id") -> DataFrame:
    """Whole rows, exactly one delivery of each request (the lowest ``order``); other columns pass through.

    Rows without identifiers stay. Rows repeated with the same ``order`` count once; rows whose
    ``order`` is null stay as they are, as nothing says which of them came first.
    """
    gone = dropped_deliveries(df, order)
    placed = df.where(F.col(order).isNotNull()).join(gone, order, "left_anti").dropDuplicates([order])
    return placed.select(*df.columns).unionByName(df.where(F.col(order).isNull()))


def merge_deliveries(stored: DataFrame, new: DataFrame, order: str = "delivery_id") -> DataFrame:
    """Stored rows and a new batch as one table with one delivery per request.

    A request that is already stored keeps its stored copy even if the new batch carries a lower
    ``order``. A new delivery can tie stored requests together; then the first stored one stays.
    """
    old, rank = fresh(stored, "_new", "_rank")
    both = stored.withColumn(old, F.lit(0)).unionByName(new.withColumn(old, F.lit(1)), allowMissingColumns=True)
    both = both.withColumn(rank, F.when(F.col(order).isNotNull(), F.struct(F.col(old), F.col(order))))
    return keep_once(both, rank).drop(old, rank)
