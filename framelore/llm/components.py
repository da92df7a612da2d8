"""Connected components of an edge table by alternating stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """``edges``: a long, b long. Returns node, component (the smallest node reachable), for nodes that have an edge.

    Each round points every larger neighbour at the smallest one (large star), then every smaller neighbour likewise
    (small star); the edge set shrinks to stars in about log(n) rounds. Only counts and checksums reach the driver.
    """
    star = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _sum(star)
    for _ in range(MAX_ROUNDS):
        if seen[0] == 0:
            break
        both = star.union(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a")
        star = materialise(small.select(F.explode(F.array("a", "b")).alias("x"), "m").where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct())
        now = _sum(star)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return star.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(star.select("b", "b").distinct())


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
