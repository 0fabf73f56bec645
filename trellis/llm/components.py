"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges (a, b).

    Each round lets every node hand its larger (then its smaller) neighbours to the least one it
    knows, which halves distances; rounds end when no edge changes. Nothing is gathered by node:
    a round is a minimum (partially aggregated) and one join that AQE may split. Self-loops and
    repeated edges do no harm; an edge with a null end is left out.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    state = None
    # a second key, which the grouping does not have: the joins shuffle either side, and AQE may split a hub
    fold = lambda c: F.xxhash64(c).alias("fold")
    while True:
        # large star: of each node's neighbours, those above it go to its least neighbour (itself included)
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"), fold("u"))
        large = both.where("v > u").select("*", fold("u")).join(least, ["u", "fold"]).select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        large = materialize(large, "large-star")
        # small star: a node and its smaller neighbours go to the least of them
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.select("*", fold("hi")).join(least.select("*", fold("hi")), ["hi", "fold"])
        small = joined.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").union(least.select("hi", F.col("m").alias("lo"))).distinct()
        before, now = now, materialize(small, "small-star")
        discard(before, large)
        new = tuple(now.agg(F.count(F.lit(1)), F.sum(F.hash("hi", "lo").cast("long")), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())
        if new == state or not new[0]:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select("lo", "lo").distinct())
        state = new
