"""Connected components by alternating star contractions on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata.llm.tables import settle

ROUNDS = 60


def _toward_least(edges: DataFrame) -> DataFrame:
    """Links every neighbour of a node to the least of the node and its neighbours.

    edges: (a, b). The least neighbour comes from a grouping with partial sums and
    returns by a join, so a node with very many neighbours is never one group.
    """
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return edges.join(least, "a")


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of edges (a, b) reaches; nodes without edges are absent."""
    pairs = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(ROUNDS):
        # settled if all pairs are stars: each node has one lower node, which has none itself
        tops = pairs.select(F.col("b").alias("a")).distinct()
        below_top = pairs.join(tops, "a", "left_semi").select("a")
        if below_top.unionByName(pairs.groupBy("a").count().where("count > 1").select("a")).isEmpty():
            break
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _toward_least(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        linked = _toward_least(down)
        small = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(linked.select("a", F.col("m").alias("b")))
        pairs = settle(small.where("a <> b").distinct())
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    stars = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
