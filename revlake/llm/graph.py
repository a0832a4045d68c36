"""Connected components on DataFrames: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes in edges (a, b), component being the smallest node reachable.

    Each step replaces the edges of a node by edges to its smallest neighbour; edges are never more than at the start, and
    the number of rounds grows with the logarithm of a component's diameter. Minimums are combined map-side and hot
    nodes are joined as skewed keys, so no neighbourhood is gathered in one place. Lineage is cut by reliable checkpoints.
    """
    current = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = _state(current)
    while state[0]:
        # Large star: every larger neighbour of a node gets the smallest of the node and its neighbours.
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours get the smallest of these.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.hint("merge"), "a")
        small = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        current = materialize(small, release=True)
        before, state = state, _state(current)
        if before == state:
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
