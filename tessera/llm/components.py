"""Connected components by alternating large-star and small-star steps, all as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import materialise


def _mark(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row.n, row.x


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node with an edge to another; root is the smallest node of its component.

    Each step is a join of the edges with the smallest neighbour of their node; edges and neighbours are
    written to the shared folder, so a lost executor costs one step. Loops, repeated edges and nulls are
    ignored. The neighbours are partially aggregated and stand by themselves in the join, so that adaptive
    execution can split the edges of a hot node.
    """
    u, v = F.col(left).cast("long"), F.col(right).cast("long")
    now = materialise(edges.where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = materialise(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = materialise(small)
        mark, before = _mark(now), mark
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
