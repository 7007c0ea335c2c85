"""Connected components of an edge list by alternating large-star and small-star steps
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014).

Every step is a grouped minimum plus a join on the same key, so the work stays spread over the
cluster and nothing is gathered per component."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Stage

MAX_ROUNDS = 60  # a guard against endless loops only; log2 of the longest path bounds the rounds


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(id, component)``: each id that has an edge to another id, with
    the smallest id reachable from it.  Loops, repeats, either direction and nulls are allowed."""
    stage = Stage(spark)
    pairs = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")
    )
    current = stage.write(pairs.distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        both = current.union(current.select("y", "x"))
        # large star: the larger neighbours of x move to the smallest member of its neighbourhood
        # (written, so that the join below reads plain shuffles, which are split where one node has most of the edges)
        low = stage.write(both.groupBy("x").agg(F.min("y").alias("low")).select("x", F.least("x", "low").alias("low")), "low")
        large = stage.write(both.join(low, "x").where("y > x").select(F.col("y").alias("x"), F.col("low").alias("y")).distinct(), "large")
        # small star: the smaller neighbours of x, and x, move to the smallest of them
        least = stage.write(large.groupBy("x").agg(F.min("y").alias("low")), "least")
        small = large.join(least, "x").where("y <> low").select(F.col("y").alias("x"), F.col("low").alias("y"))
        following = stage.write(small.union(least).distinct(), "edges")
        for done in (current, low, large, least):
            stage.drop(done)
        current = following
        mark = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(20,0)"))).first()
        if mark == seen:
            return current.select(F.col("x").alias("id"), F.col("y").alias("component")).union(
                current.select(F.col("y"), F.col("y")).distinct()
            )
        seen = mark
    raise RuntimeError("the components did not settle")
