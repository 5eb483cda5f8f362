"""Connected components by alternating large-star and small-star steps, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kittally.session import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    Edges may repeat and come in either direction; loops and edges with a null end are ignored. Every
    step is a partial aggregate and a join, and each round's edges are cut to the shared folder, so no
    component is gathered in one task. Rounds grow with the logarithm of the longest path.
    """
    u, v = F.col(left).cast("long"), F.col(right).cast("long")
    now = cut(edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    seen = _state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            now.select(F.col("v").alias("u"), F.col("u").alias("w"))
            .join(least, "u")
            .select(F.col("w").alias("u"), F.col("m").alias("v"))
            .unionByName(now.select("u", F.col("u").alias("w")).join(least, "u").where("m < u").select("u", F.col("m").alias("v")))
            .where("u > v")
            .distinct()
        )
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select(F.col("e.a").alias("u"), F.col("e.b").alias("v"))
            .where("u > v")
            .distinct()
        )
        now = cut(small)
        state = _state(now)
        if state == seen:
            break
        seen = state
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(roots)
