"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botlens.session import drop_path, stage


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b longs): the component's least node.

    Alternates large-star and small-star steps; a step sends each edge once and
    takes the least neighbour of a node by a partial aggregation, so the edges
    of a hub are combined before the shuffle.  Each round is cut by a written
    table, and the tables of the round before are removed.  The rounds grow
    with the logarithm of the longest chain.
    """
    pairs = lambda df: df.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    old: list[str] = []
    current = stage(pairs(edges), "edges", old)
    for _ in range(max_rounds):
        new: list[str] = []
        # large-star: every larger neighbour of a node is tied to the node's least neighbour
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "_a")
        large = pairs(both.filter("b > a").join(least, F.col("a") == F.col("_a"))
                      .select(F.col("b").alias("a"), F.col("m").alias("b")))
        # small-star: a node's smaller neighbours are tied to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "_a")
        small = (large.join(low, F.col("a") == F.col("_a"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select(F.col("_a").alias("a"), F.col("m").alias("b"))))
        following = stage(pairs(small), "edges", new)
        # a fixed point: every node has one edge, to a root that has none of its own
        roots = following.select(F.col("b").alias("a")).distinct()
        loose = (following.groupBy("a").agg(F.count("*").alias("n"))
                 .join(roots.withColumn("root", F.lit(True)), "a", "left")
                 .filter("n > 1 or root").limit(1).count())
        for path in old:
            drop_path(edges.sparkSession, path)
        current, old = following, new
        if not loose:
            tied = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return tied.union(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
