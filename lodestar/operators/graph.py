"""Connected components of text-named nodes by alternating large-star and small-star steps over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.publish import written


#: Edges beyond which a step writes its least neighbours, so that Spark can split the join at a node that very many edges meet.
SPLIT = 1_000_000


def _step(edges: DataFrame, large: bool, split: bool) -> DataFrame:
    down = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    near = down.union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))) if large else down
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    if split:
        least = written(least)
    moved = near.join(least, "u")
    to = moved.where("v > u") if large else moved
    out = to.select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    if not large:
        out = out.union(least.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
    return out.where("hi <> lo").distinct()


def components(nodes: DataFrame, edges: DataFrame, node: str = "node", a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): each node with the least node that edges reach from it; edges may name nodes that aren't listed."""
    now = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before, split = state, state[0] > SPLIT
        now = written(_step(written(_step(now, True, split)), False, split))
    return nodes.select(F.col(node).alias("node")).distinct().join(now.select(F.col("hi").alias("node"), F.col("lo").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
