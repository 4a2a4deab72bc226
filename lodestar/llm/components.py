"""Connected components by alternating large-star and small-star steps; no edge or label ever leaves the executors.

Edges that are null on either side or link a node with itself are ignored; repeated edges count once. An empty edge table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


#: Edges beyond which a step writes its least neighbours, so that Spark can split the join at a node that very many edges meet.
SPLIT = 1_000_000


def _stars(edges: DataFrame, large: bool, split: bool) -> DataFrame:
    """One step: (hi, lo) edges to (hi, lo) edges of which the lower ends are closer to the smallest node."""
    down = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    around = down.union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))) if large else down
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    if split:
        least = written(least)
    moved = around.join(least, "u")
    if large:
        moved = moved.where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    else:
        moved = moved.select(F.col("v").alias("hi"), F.col("m").alias("lo")).union(least.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
    return moved.where("hi <> lo").distinct()


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root): every node of an edge with the smallest node that it reaches."""
    a, b = F.col(left), F.col(right)
    now = written(edges.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), few=True)
    state = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            break
        state, split = seen, seen[0] > SPLIT
        now = written(_stars(written(_stars(now, True, split), few=True), False, split), few=True)
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
