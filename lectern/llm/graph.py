"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, materialize


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star step and one small-star step over edges (hi, lo), hi > lo.

    Each node's smallest neighbour is found by a combining aggregate and joined
    back, so a node with many links is never gathered anywhere.
    """
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo"), F.col("hi")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi > lo").distinct()
    low = large.groupBy("hi").agg(F.min("lo").alias("m"))
    small = large.join(low, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi > lo")
    return small.union(low.select("hi", F.col("m").alias("lo"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link; component is the smallest node reached.

    ``links`` holds pairs of whole numbers in any direction; loops, repeated
    links and nulls do no harm.  The number of rounds grows with the logarithm
    of the longest path; each round's edges are a written table.
    """
    edges = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi > lo").distinct()
    edges = materialize(edges, "edges")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state, before = now, edges
        edges = materialize(_stars(before), "edges")
        drop(before)
    out = edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        edges.select(F.col("lo"), F.col("lo")).distinct()
    )
    out._lectern_path = edges._lectern_path
    return out
