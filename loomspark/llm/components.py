"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import deleted, staged


def components(links: DataFrame) -> DataFrame:
    """node and root (the component's smallest node) for each node that links (columns a, b) name.

    Every round hangs each node's larger neighbours, then its smaller ones, on the smallest
    node around it; rounds end when nothing moves. A node with many links is never gathered:
    rounds are minima and joins. Links with a null end, and of a node with itself, are ignored.
    """
    edges = staged(_distinct(links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))))
    mark = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        mark = now
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = staged(_distinct(both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))))
        own = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(own, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        before, edges = edges, staged(_distinct(small.unionByName(own.select("hi", F.col("m").alias("lo")))))
        for done in (before, large):  # the next table holds all that they did
            deleted(done)


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.filter("hi <> lo").distinct()
