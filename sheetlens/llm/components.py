"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``; root is the smallest node reachable.

    Large-star and small-star steps: every node hands its neighbours to the smallest of them, until
    all links point at roots. Minima are aggregated with partial aggregates, and the neighbours meet
    them in a join whose large partitions Spark can split, so a node with very many links is not
    gathered in one task. Each round is
    written to the shared folder, and the one before it is deleted. The number of rounds grows with the logarithm of the longest
    chain; ``rounds`` is a guard that raises, never a cut.
    """
    links = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(rounds):
        # large star: each neighbour that is larger than the node goes to the node's minimum
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = saved(both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m")), "low")
        large = saved(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        # small star: each smaller neighbour, and the node, go to the minimum
        least = saved(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        old, links = links, saved(small, "links")
        discard(old, low, large, least)
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
