"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour (or itself)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b")


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them.  edges: a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    tied = edges.join(least, "b").where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return tied.unionByName(least.select(F.col("m").alias("a"), "b"))


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root): for every node that has an edge, the smallest node reachable from it.

    edges: (a, b), undirected; loops and repeats are ignored.  Each round is written to the shared folder, so
    lineage stays short and a lost executor costs one round at most.  It ends when no edge changes.  The joins
    are plain hash exchanges on the node, which adaptive execution splits for hubs.
    """
    now = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now, seen = materialize(now, "edges"), None
    for _ in range(max_rounds):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        now = materialize(_small_star(_large_star(now).where("a <> b").distinct()).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
