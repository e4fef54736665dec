"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """u, m: the least of u and its neighbours. Aggregated before the shuffle, so that a node of very many edges costs no more."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node, root for every node of edges(a, b): root is the least node that can be reached.

    Rows with a null end and loops are ignored; repeated and reversed edges count once. Each round is written to the shared
    folder. The rounds stop when the edges no longer change: every edge then leads from a node to its root.
    """
    digest = lambda frame: frame.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    ends = edges.where(F.col("a") != F.col("b"))
    now = materialize(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    was = digest(now)
    if not was.n:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: each larger neighbour of u is linked to the least one.
        large = both.join(_least_neighbour(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours are linked to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(small, "edges")
        if (same := digest(after)) == was:
            break
        now, was = after, same
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
