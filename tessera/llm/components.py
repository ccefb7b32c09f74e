"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a long, b long) in any direction, to (node, component): the smallest node reachable, of every node but the
    smallest ones themselves.

    Each round hooks every neighbour of a node to the smallest node of its neighbourhood, so edges never grow in
    number and a component of diameter d becomes a star in about log d rounds. Every round is written to the shared
    folder; once all is stars there are no more. No edges: no rows. Loops and repeated edges are dropped; edges with a
    null end too. Joins are merged, never broadcast: rounds are many, and what is broadcast stays with the driver."""
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a <> b").distinct())
    for _ in range(max_rounds):
        # stars: every larger end has one edge, and is no edge's smaller end
        ends = now.select(F.col("u").alias("n"), F.lit(1).alias("up")).union(now.select("v", F.lit(0)))
        ends = ends.groupBy("n").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
        if not ends.agg(F.coalesce(F.max(F.expr("ups > 1 or ups = 1 and least = 0")), F.lit(False))).first()[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low.hint("merge"), F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # after a large star every edge points from a larger to a smaller node
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(least.hint("merge"), F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        now = cut(small.where("u <> v").distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
