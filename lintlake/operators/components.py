"""Connected components by alternating large-star and small-star steps (logarithmic number of rounds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.session import materialize


def _both(e: DataFrame) -> DataFrame:
    return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(e: DataFrame, hubs: DataFrame) -> DataFrame:
    """Every (u, v) of ``e`` becomes (v, smallest of u's hub)."""
    return e.join(hubs, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _mark(e: DataFrame):
    return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for undirected edges (u, v): component is the smallest node of the component.

    Large-star links every larger neighbour of a node to the smallest neighbour; small-star links a node and its smaller
    neighbours to the smallest.  The edges shrink to stars; the loop ends when a round leaves them unchanged.  Each round
    is written to the checkpoint folder; minima are aggregated before the shuffle, so a hub of any degree is fine.
    """
    e = materialize(edges.select("u", "v").filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _mark(e)
    while before[0]:
        two = _both(e)
        hubs = two.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = materialize(_star(two.filter("v > u"), hubs).distinct(), "large-star")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = _star(down, least).unionByName(least.select("u", F.col("m").alias("v")))
        e = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "small-star")
        after = _mark(e)
        if after == before:
            break
        before = after
    nodes = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node")).distinct().join(nodes.select("node"), "node", "left_anti").withColumn("component", F.col("node")))
