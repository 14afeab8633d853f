"""Connected components of an edge table by alternating large and small stars.

Each round points every node's neighbours at the smallest of them, first those above the node, then
those below; rounds end when nothing moves. All is aggregation and joins on one row per edge, and edges
never become more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.session import cut_lineage


def _least(edges: DataFrame, both: bool) -> DataFrame:
    """Rows (v, u, least): u a neighbour of v, least the smallest of v and its neighbours. Only a value per
    node is aggregated, and the join on a node with very many neighbours may be split."""
    directed = edges.select(F.col("a").alias("v"), F.col("b").alias("u"))
    if both:
        directed = directed.union(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
    low = directed.groupBy("v").agg(F.min("u").alias("low")).select("v", F.least("v", "low").alias("least"))
    return directed.join(low, "v")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the smallest node reachable."""
    edges = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        large = _least(edges, True).where("u > v").select(F.col("u").alias("a"), F.col("least").alias("b"))
        large = large.where("a <> b").distinct()
        small = _least(large, False)
        small = small.select(F.col("u").alias("a"), F.col("least").alias("b")).union(small.select(F.col("v").alias("a"), F.col("least").alias("b")))
        edges = cut_lineage(small.where("a <> b").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or now[0] == 0:
            break
        before = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return roots.union(roots.select("component", "component")).distinct()
