"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certame.llm.storage import staged


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each end of edges (a, b) reaches.

    Every round hooks all neighbours of a node to its smallest one, first the larger
    neighbours, then the smaller ones; the number of rounds grows with the logarithm of
    the longest path. Minima are pre-aggregated before they move. Nodes without edges are absent.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        both = now.union(now.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        after = staged(large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "edges")
        stars = after.groupBy("a").agg(F.count("*").alias("n")).where("n > 1")
        # a forest of stars: every node has one parent, and no parent has a parent
        if stars.isEmpty() and after.join(after.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            now = after
            break
        now = after
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
