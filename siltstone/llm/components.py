"""Connected components of a graph of edges, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, *, most_rounds: int = 200) -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges (columns a, b).

    Alternates two steps until nothing changes: each node's larger neighbours are linked to its smallest
    neighbour, then its smaller ones are. The number of rounds grows with the logarithm of the longest path.
    Minima are aggregated before they are shuffled, so a node with very many neighbours is no hot group.
    """
    # the edges always run from the larger node to the smaller one
    now = materialize(_ordered(edges.select("a", "b")), "edges")
    for _ in range(most_rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _ordered(both.join(lowest, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")))
        large = materialize(large, "large_star")
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(lowest, "a")
        small = linked.select("a", F.col("m").alias("b")).unionByName(linked.select(F.col("b").alias("a"), F.col("m").alias("b")))
        after = materialize(_ordered(small), "small_star")
        changed = after.exceptAll(now).limit(1).count() or now.count() != after.count()
        now = after
        if not changed:
            nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
