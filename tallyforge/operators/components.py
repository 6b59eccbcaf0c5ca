"""Connected components of an undirected link table.

Alternating large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014): every round is two aggregations and joins, the number of rounds grows with the
logarithm of the longest chain, and neither node lists nor links reach the driver. A hub is handled
by aggregating its smallest neighbour before the join, never by collecting its neighbours; what is
left of its skew is an equi-join that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.runtime import cut


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    low = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("m", "src").alias("m"))
    return (
        both.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        .where("src <> dst").distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    low = down.groupBy("src").agg(F.min("dst").alias("m"))
    return (
        down.join(low, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        .union(low.select("src", F.col("m").alias("dst"))).where("src <> dst").distinct()
    )


def _signature(links: DataFrame) -> tuple:
    """Number of links and the sum of their hashes."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Label of every linked node: ``(node, component)``, the component named by its smallest node.

    ``links`` are pairs in any direction, repeats and self-links allowed; rows with a null end are
    ignored. A node that occurs only in self-links is its own component. An empty table gives an
    empty result. Raises if the labels have not settled after ``max_rounds``.
    """
    base = links.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null")
    selves = base.where("src = dst").select("src")
    state = cut(_small_star(base.where("src <> dst")))
    seen = _signature(state)
    for _ in range(max_rounds if seen[0] else 0):
        state = cut(_small_star(_large_star(state)))
        # the link set is a forest of stars when a round no longer changes it
        now = _signature(state)
        if now == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labels = state.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    roots = state.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    linked = labels.union(roots)
    alone = selves.select(F.col("src").alias("node")).distinct().join(linked, "node", "left_anti")
    return linked.unionByName(alone.select("node", F.col("node").alias("component")))
