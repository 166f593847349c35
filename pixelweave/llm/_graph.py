"""Connected components by alternating star contraction over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.llm._common import stage


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """Columns ``node`` and ``component`` (the least node reachable) for every node of ``edges(a, b)``.

    Each round hangs the larger neighbours of a node, then its smaller ones, below the least node
    it knows (large star, small star). Least nodes come from partial aggregates, so a hub's edges
    are never gathered; the joins are plain equi-joins, whose hot keys Spark splits. Every round
    ends in a table in the shared folder. Rounds grow with the logarithm of the largest component; if
    so many don't suffice an error is raised.
    """
    now = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    total = _sum(now)
    for _ in range(rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        now = stage(small, "edges")
        if (seen := _sum(now)) == total:
            break
        total = seen
    else:
        raise RuntimeError(f"components: edges still change after {rounds} rounds")
    top = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return top.union(top.select(F.col("component").alias("node"), "component").distinct())


def _sum(edges: DataFrame) -> tuple:
    """A checksum of the edges that is equal once a round changes nothing."""
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]
