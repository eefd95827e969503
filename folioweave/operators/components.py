"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioweave.operators.joins import shuffled
from folioweave.session import materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """(node, component): each node that has an edge with the smallest node it can reach.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each round links
    every larger neighbour, then every smaller one, to the smallest neighbour known.  The
    number of edges never grows, a star's hub is never gathered in one row, and the rounds
    needed are about the logarithm of the longest path.  Each round's edges are written to
    the shared folder.  NULL nodes and self loops are ignored; an empty table gives an empty
    result.
    """
    if edges.schema[a].dataType != edges.schema[b].dataType:
        raise ValueError("both ends of an edge must have one type")
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct()
    e = materialise(e)
    last = None
    for _ in range(max_rounds):
        # large star: v > u gets linked to the least of u and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(shuffled(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: u and its smaller neighbours get linked to the least of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(shuffled(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        e = materialise(small.distinct())
        seen = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1_000_000_007))).first()
        if last == tuple(seen):
            break
        last = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
