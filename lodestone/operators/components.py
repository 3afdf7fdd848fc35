"""Distributed union-find: connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.scratch import materialize, shuffles_go


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex hands its larger neighbours to the least of its neighbours and itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u").where(F.col("v") > F.col("u"))
    # what comes twice goes with the small star's distinct rows
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex hands its smaller neighbours and itself to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _only_stars(edges: DataFrame) -> bool:
    """Whether every vertex with an edge down has no other edge; ``u`` is above ``v`` in every edge."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    seen = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    with shuffles_go(edges.sparkSession):
        return seen.where("down > 0 and down + up > 1").isEmpty()


def connected_components(edges: DataFrame, left: str, right: str, name: str = "component") -> DataFrame:
    """``(vertex, component)`` for every vertex with an edge; the component is its least vertex.

    Alternates large-star and small-star until only stars are left, which takes
    O(log^2 n) rounds on any graph; each round is cut as a table, so only the last is
    ever recomputed.  Minima are taken by partial aggregation and the joins are plain
    equi joins that adaptive execution may split, so a hub is not one task's work.
    Whether only stars are left is one aggregate; of single edges at most one reaches the driver.
    """
    now = materialize(edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct(), "edges")
    while not _only_stars(now):
        now = materialize(_small_star(_large_star(now)), "star")
    stars = now.groupBy("u").agg(F.min("v").alias("v"))
    roots = stars.select(F.col("v").alias("vertex"), F.col("v").alias(name)).distinct()
    return stars.select(F.col("u").alias("vertex"), F.col("v").alias(name)).unionByName(roots)
