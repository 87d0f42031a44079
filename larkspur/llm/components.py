"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, remove, spread_join, stored


def _least(edges: DataFrame) -> DataFrame:
    """Each node's smallest neighbour, itself included, and the number of its edges."""
    return edges.groupBy("u").agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "least").alias("least"), "n")


def large_star(edges: DataFrame, size: int) -> DataFrame:
    """Every neighbour larger than a node is hung onto the node's smallest neighbour. size: number of edges.

    The nodes of many edges, 2 * size / HOT at most, are broadcast to their edges.
    """
    both = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(edges.select(F.col("dst").alias("u"), F.col("src").alias("v")))
    return spread_join(both.where("v > u"), _least(both), "u", "n", 2 * size // HOT).select(F.col("v").alias("src"), F.col("least").alias("dst"))


def small_star(edges: DataFrame, size: int) -> DataFrame:
    """A node and its smaller neighbours are hung onto the smallest of them."""
    down = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v")
    # the smallest neighbour's own row hangs the node itself
    hung = F.when(F.col("v") == F.col("least"), F.col("u")).otherwise(F.col("v"))
    return spread_join(down, _least(down), "u", "n", size // HOT).select(hung.alias("src"), F.col("least").alias("dst"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (smallest node reachable) of every node on an edge (src, dst).

    Each half of a round is written to the shared folder, so lineage and plans stay short and a lost executor costs
    that half at most. Only a count of the edges and whether they are settled reach the driver; edges that are
    settled need no round. Raises if not settled after max_rounds (rounds grow with the logarithm of the largest component).
    """
    spark = edges.sparkSession
    now, path = stored(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst").distinct(), "components")
    rounds = 0
    while True:
        size, open_ = _state(now)
        if not open_:
            return now.select(F.col("src").alias("node"), F.col("dst").alias("component"))
        if rounds == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        large, large_path = stored(large_star(now, size), "components-large")
        remove(spark, path)
        now, path = stored(small_star(large, 2 * size).distinct(), "components")
        remove(spark, large_path)
        rounds += 1


def _state(edges: DataFrame) -> tuple[int, bool]:
    """Number of the edges (src > dst), and whether any is not settled: stars, each node hung onto one that isn't hung itself."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("up")).union(edges.select("dst", F.lit(0)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    size, open_ = nodes.agg(F.sum("up"), F.max((F.col("up") > 1) | (F.col("up") > F.col("least")))).first()
    return size or 0, bool(open_)
