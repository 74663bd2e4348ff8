"""Connected components of a graph whose edges may not fit on one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlake.llm.common import cut, with_least


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) for each node of an edge; alternating large and small stars.

    Each round sends a node's neighbours to the smallest of them; rounds grow with the logarithm of the graph's size.
    Edges of a node with itself and repeated edges are allowed; null ends are left out. Rounds are cut by checkpoints.
    """
    e = edges.select(F.greatest(F.col(a), F.col(b)).alias("u"), F.least(F.col(a), F.col(b)).alias("v")).where(F.col("u") > F.col("v")).distinct()
    e = cut(e)
    state = _state(e)
    while state[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, "u", "v", "m").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = cut(large.distinct())
        small = with_least(large, "u", "v", "m").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        state, before = _state(e), state
        if state == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
    return r[0], r[1], r[2]
