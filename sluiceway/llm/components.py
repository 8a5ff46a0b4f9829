"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch

#: Nodes of most links that are broadcast, at most; and the fewest links of such a node.
HEAVY, HEAVY_LINKS = 100_000, 64


def _with_least(edges: DataFrame, n: int, scratch: Scratch, own: bool) -> tuple[DataFrame, DataFrame]:
    """``u, v, m`` of each edge, m the least neighbour of u (or u itself if ``own``), and ``u, m`` of each node.

    Of n edges fewer than ``HEAVY`` nodes can have more than 2 n / HEAVY; these are broadcast, so
    the edges of a hub stay where they are.  All other nodes have few edges and are shuffled.
    """
    least = F.least(F.min("v"), F.first("u")) if own else F.min("v")
    nodes = scratch.keep(edges.groupBy("u").agg(least.alias("m"), F.count(F.lit(1)).alias("d")), "least")
    most = max(HEAVY_LINKS, 2 * n // HEAVY)
    heavy = F.broadcast(nodes.filter(F.col("d") > most).select("u", "m"))
    light = nodes.filter(F.col("d") <= most).select("u", "m")
    met = edges.join(heavy, "u").unionByName(edges.join(heavy, "u", "left_anti").join(light, "u"))
    return met, nodes


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``u, component`` of each node that has a link to a smaller one; ``links`` has columns ``a, b``.

    The component is its smallest node.  Each round replaces links by links to the least
    neighbour, first of larger nodes, then of smaller ones, so a round halves paths.  Minima
    are aggregated before the shuffle, and nodes with many links meet theirs by a broadcast,
    hence a hub is no single task's work.  Links to oneself and nulls are dropped.
    """
    e = scratch.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "links")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        met, least = _with_least(both, 2 * e.count(), scratch, True)
        large = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        large = scratch.keep(large, "large")
        met, smaller = _with_least(large, large.count(), scratch, False)
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        small = scratch.keep(small.unionByName(smaller.select("u", F.col("m").alias("v"))).distinct(), "small")
        scratch.drop(e, large, least, smaller)
        e = small
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select("u", F.col("v").alias("component"))
        seen = now
