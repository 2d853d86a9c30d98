"""Connected components of an edge table by alternating large-star and small-star steps (no driver-side links)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlgauge.llm.common import written

#: A round at least halves the depth of what is left, so this many rounds do for any table that fits a cluster.
MAX_ROUNDS = 60


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Large: every node's greater neighbours join its least; small: its lesser neighbours and it do."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        joined = both.join(least, "a").where("b > a").select(F.col("b").alias("x"), F.col("least").alias("y"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("least"))
        near = down.join(least, "a").select(F.col("b").alias("x"), F.col("least").alias("y"))
        joined = near.unionByName(least.select(F.col("a").alias("x"), F.col("least").alias("y")))
    return joined.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) of every node that has an edge; the component is its least id. ``edges`` has a and b."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges")
    state = None
    for _ in range(MAX_ROUNDS):
        after = written(_stars(_stars(now, True), False), f"{name}-round")
        sums = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        now = after
        if tuple(sums) == state:
            break
        state = tuple(sums)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
