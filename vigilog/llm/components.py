"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node of the edges ``a, b``.

    In turn, every node hands the least of its neighbours and itself to all larger neighbours, and
    then to all smaller ones; edges of a component so become a star around its smallest node, in a
    number of rounds that grows with the logarithm of its size. Each round is two aggregates over
    edges and joins by node, and is written to the shared folder. Nulls, loops and repeated edges
    are left out.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = materialise(edges.filter("a > b").distinct(), "links")
    before = None
    while True:
        large = _large_star(edges)
        small = materialise(_small_star(large), "links")
        # The stars stay as they are once every node hangs on the least of its component.
        now = small.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        edges = small
        if now == before:
            break
        before = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    joined = both.join(least, F.col("a") == F.col("k")).filter("b > a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
    joined = edges.join(least, F.col("a") == F.col("k"))
    down = joined.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct()
