"""Connected components of a link table by alternating stars, in tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featherloom.llm.tables import stored


def components(links: DataFrame) -> DataFrame:
    """``links``: (a, b) of one sortable type. Returns (node, root), root the smallest node reachable, for every node that has a link.

    Each round points all larger neighbours of a node at its smallest neighbour (large star), then all
    smaller ones (small star). Both keep the components; the number of rounds grows with the logarithm
    of the longest path. A hot node's links are grouped by a minimum and joined back, never collected.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before, state = None, _state(edges)
    while state[0] and state != before:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        # Small star: what a node still points at is pointed at the smallest of it.
        lowest = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(lowest, "a").select(F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = stored(small.filter("a <> b").distinct(), "links")
        before, state = state, _state(edges)
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    tops = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return roots.unionByName(tops).groupBy("node").agg(F.min("root").alias("root"))


def _state(edges: DataFrame) -> tuple:
    """Number of links and an order-free digest; equal before and after a round: nothing moved."""
    return tuple(edges.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))"), F.expr("bit_xor(xxhash64(b, a))")).first())
