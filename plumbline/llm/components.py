"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Every neighbour of a node points at the smallest one. Minima are combined before the shuffle and written, so
    that the join is between two plain tables and a node with very many neighbours can be split."""
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m")), "star").withColumn("m", F.least("u", "m"))
    moved = edges.join(least, "u").filter("v > u" if larger_only else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved if larger_only else moved.union(least.filter("u <> m").select("u", F.col("m").alias("v")))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge table (a, b) of longs; root is the smallest node reachable.

    Rounds grow with the logarithm of the longest path; each writes its edges. Loops and repeated edges do no harm.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        seen = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(_star(both, True).distinct(), "edges")
        now = cut(_star(large, False).distinct(), "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
