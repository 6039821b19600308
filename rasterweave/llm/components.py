"""Connected components by alternating large and small stars, written to shared storage each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterweave.llm.common import discard, saved


def _large_star(edges: DataFrame) -> DataFrame:
    """Links the larger neighbours of every node to the smallest of the neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links every node and its smaller neighbours to the smallest of them; u > v on both sides."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """``u, v`` (longs, in any order) to ``node, component``, the smallest reachable node.

    Nodes without an edge to another node are left out. Ends when a round changes nothing: a star
    forest is its own image. Rounds grow with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    current = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), folder, f"{name}-0")
    mark, k = None, 0
    while True:
        summary = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if summary["n"] == 0 or summary == mark:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark, k = summary, k + 1
        current = saved(_small_star(_large_star(current)), folder, f"{name}-{k}")
        discard(spark, f"{folder}/{name}-{k - 1}")
