"""Connected components of a graph of links, by alternating large-star and small-star steps.

Every step is an aggregation with a join back, written to the shared folder, so nothing meets in
one task or on the driver; a hot node's links are pre-aggregated, and its join can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import storage


def _with_min(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with ``m``, the least of u's neighbours and u itself."""
    low = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return edges.join(low, "u")


def connected(links: DataFrame) -> DataFrame:
    """``node`` and ``comp``, the least node it is connected with, for every node of ``links``
    (columns a, b; at most one row for each pair is best)."""
    edges = storage.stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_min(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _with_min(large)  # all have v < u
        new = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(small.select("u", F.col("m").alias("v"))).distinct()
        after = storage.stage(new, "links")
        now = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        storage.drop(edges)
        edges = after
        if tuple(now) == before:
            break
        before = tuple(now)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select("v", F.col("v").alias("c")).distinct())
