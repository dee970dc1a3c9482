"""Connected components of an edge table by alternating large-star and small-star joins.

Every step is a map-side minimum and a join; each round is stored in the shared folder,
so a lost executor costs one round at most. The labels are the smallest node reachable.
Repeated edges between the two steps of a round are left in: they are no more than the round began with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raceflow.session import cut_lineage, release


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    return (down.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                       F.col("m").alias("v")).filter("u <> v").distinct())


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v)."""
    edges = cut_lineage(edges.select("u", "v").filter("u <> v").distinct())
    while True:
        edges = cut_lineage(_small_star(_large_star(edges)))
        # done when every node points once, and at a node that points nowhere
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out")).unionByName(
            edges.select(F.col("v").alias("x"), F.lit(0).alias("out")))
        bad = ends.groupBy("x").agg(F.sum("out").alias("out"), F.count_if(F.col("out") == 0).alias("into"))
        done = bad.filter("out > 1 OR (out = 1 AND into > 0)").isEmpty()
        release(edges.sparkSession)
        if done:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
