"""Connected components by alternating stars, as DataFrame joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import dropped, tidied


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes in edges (a, b): the component is its least node.

    Each round links, for every node, its higher neighbours and then its lower ones to the least
    neighbour. The rows don't grow in number, a hub's neighbours meet its least one in a join that adaptive execution splits, and every round is written to
    the shared folder, where the round before it is deleted. It ends when every node hangs on its component's least node.
    """
    spark = edges.sparkSession
    now = tidied(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    last, before = None, None
    for _ in range(most_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1000003), F.sum(F.hash("a", "b").cast("long"))).first()
        if before:
            dropped(spark, before)
        if state == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        last, before = state, now._tidemark_path
        both = _both(now)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("x"), "m", "a")
        stars = small.filter("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        now = tidied(stars.filter("a <> b").distinct(), "stars")
    raise RuntimeError("components did not settle")
