"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import met, written


def _minimum(edges: DataFrame) -> DataFrame:
    """Each u with the smallest of itself and its neighbours, and how many edges it has. Grouping combines before the shuffle, so a hub costs a row per task."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return written(low.select("u", F.least("u", "m").alias("m"), "n"), "lowest")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return met(both, _minimum(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _minimum(down)
    moved = met(down, low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(low.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """edges(u long, v long) -> (node, root), root the smallest node that can be reached; nodes without an edge don't appear.

    Loops and repeated edges are ignored, an empty table gives an empty one. Each
    round writes the remaining edges to the shared folder; the number of rounds
    grows with the logarithm of the longest path. No component is gathered
    anywhere: a round is two groupings and two joins with one row per key on one side,
    in which the edges of a hub stay where they are.
    """
    now = written(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark or seen[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = tuple(seen)
        star = written(_large_star(now).filter("u != v").distinct(), "star")
        now = written(_small_star(star).filter("u != v").distinct(), "edges")
