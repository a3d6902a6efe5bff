"""Connected components of a graph given as edges, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``src, dst``, longs); component is its least node.

    Each round links every node to the least node near it (large star, then small star) until every edge
    points at the least node of its component. Self-loops and repeated edges don't matter; no edges give
    no rows. An edge is never collected, and only a count and a checksum of a round reach the driver.
    """
    pairs = edges.filter("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct()
    pairs, before = cut(pairs), None
    for _ in range(rounds):
        # Large star: neighbours above a node move to the least of its neighbourhood.
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: neighbours below a node, and the node, move to the least of them.
        down = large.filter("a <> b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a")
        moved = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        pairs = cut(moved.filter("a <> b").distinct())
        now = pairs.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if before == now:
            break
        before = now
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
