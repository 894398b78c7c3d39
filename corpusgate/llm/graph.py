"""Connected components of an edge table by alternating large-star and small-star joins."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgate.llm.common import staged, unstaged


def _stamp(edges: DataFrame) -> tuple:
    """Row count and an order-free checksum: equal stamps mean that a round changed nothing."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: bigint); root is the smallest node of its component.

    Each round hangs every node's larger neighbours, then every node itself, on
    the smallest neighbour. Minima are aggregated before they are shuffled and
    joined back, so a hub's neighbours stay spread over tasks; the number of
    rounds grows with the logarithm of the longest path. Every round is written
    to the shared checkpoint folder, so a lost executor repeats one round at most.
    """
    now = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                 .distinct(), "star")
    stamp = _stamp(now)
    while stamp[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .filter("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
                 .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        last, now = now, staged(small, "star")
        unstaged(last)
        before, stamp = stamp, _stamp(now)
        if stamp == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
