"""Connected components of an edge table, by alternating star contraction in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketsense.session import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is tied to the least of them (edges have a > b)."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.filter("a != b").union(least.select("a", F.col("least").alias("b"))).distinct()


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root): the least node of each component, for every node that has an edge other than the root itself.

    Each round is two joins and two aggregations with partial sums; a node with very
    many edges is split by the adaptive skew join.  The number of rounds grows with
    the logarithm of the longest chain.  Every round is written to the shared folder.
    """
    ordered = edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).filter("a != b").distinct()
    current = stage(ordered, "edges")
    mark = None
    while True:
        state = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (state.n, state.h) == mark or state.n == 0:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = (state.n, state.h)
        current = stage(_small_star(_large_star(current)), "edges")
