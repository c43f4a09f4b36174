"""Connected components of an edge table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame, label: str = "components", most: int = 100) -> DataFrame:
    """key, component (the smallest key reachable) of every key in edges(a, b).

    Alternating large-star and small-star steps: each turns the edges of a node into edges to its
    smallest neighbour, so depth halves while the number of edges stays bounded by the input's. A
    hub's neighbours are never gathered: the minimum is a map-side aggregate, stored and joined back, so that
AQE splits a hub's edges like any hot join key.
    """
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    e = materialize(e, label)
    for _ in range(most):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        last = e
        low = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{label}-least")
        # large star: larger neighbours b of a point at the least neighbour of a
        large = both.where("b > a").join(low, "a").select(F.col("b"), F.col("m").alias("a")).distinct()
        large = materialize(large, label)
        # small star: of each node's smaller neighbours, all point at the least
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(down, "b")
        small = joined.where("a <> m").select("m", F.col("a").alias("b")).unionByName(joined.select("m", "b"))
        new = materialize(small.select(F.col("m").alias("a"), "b").distinct(), label)
        # settled once each node has one smaller neighbour and none is both a root and a child
        ends = new.select(F.col("a").alias("key"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.unionByName(new.select(F.col("b").alias("key"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("key").agg(F.max("up").alias("up"), F.sum("down").alias("down"))
        e = new
        discard(last, low, large)
        if ends.where("down > 1 or (up = 1 and down = 1)").isEmpty():
            break
    else:
        raise RuntimeError(f"no fixed point after {most} rounds")
    leaves = e.select(F.col("b").alias("key"), F.col("a").alias("component"))
    return leaves.unionByName(e.select(F.col("a").alias("key"), F.col("a").alias("component")).distinct())
