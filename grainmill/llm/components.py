"""Connected components of an edge table by alternating star contraction.

Large stars hang every larger neighbour on the smallest node seen, small stars
do the same for the smaller ones; a few rounds leave each component as one star
around its smallest node. Only groupBy, join and distinct are used, each round
is written to the shared folder, and nothing of the graph reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node.

    Nulls and self-loops are no edges; repeated edges count once; an empty table
    gives an empty result. The aggregations combine on the map side and the joins
    are plain sort-merge joins that AQE may split, so a hub may touch a third of
    all edges.
    """
    a, b = F.col(a), F.col(b)
    e = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(a.isNotNull() & b.isNotNull() & (a != b)).distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(e):
            break
        now = materialize(_small(_large(e)), "edges")
        discard(e)
        e = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


def _settled(e: DataFrame) -> bool:
    """Every edge leads from a leaf to the centre of its star."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select("v", "u")).toDF("x", "y")
    low = both.groupBy("x").agg(F.min("y").alias("m"))
    return both.join(low, "x").where("y > x").select(F.col("y").alias("u"), F.least("x", "m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.toDF("u", "v")).distinct()
