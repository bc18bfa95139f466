"""Consolidating pairwise matches into groups: connected components by alternating large-star and small-star.

Every edge rewrite is a groupBy minimum and a join on the same key; a hub's minimum is one row, so a hub that holds a
third of all edges only spreads its edges, which the adaptive skew join splits. Edges are pairs of longs; nothing
gets to the driver but two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u > v, distinct. Large star links every larger neighbour of a node to the least of its neighbourhood;
    small star does so with the smaller neighbours and the node itself."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(pairs: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """One row (id, group_id) for each id in a component of two or more; group_id is the component's least id.

    pairs: columns a and b, longs in either order, repeated or equal; a row with a null or with a = b links nothing.
    An empty input gives no rows; other columns are ignored.
    """
    scratch = Scratch(pairs.sparkSession, name)
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = scratch.write(pairs.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")
    mark = None
    while True:
        mid = scratch.write(_star(edges, True), "large")
        scratch.drop(edges)
        edges = scratch.write(_star(mid, False), "small")
        scratch.drop(mid)
        s = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (s.n, s.h) == mark:  # the same edges as a round ago
            break
        mark = (s.n, s.h)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("group_id")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("group_id")).distinct())
