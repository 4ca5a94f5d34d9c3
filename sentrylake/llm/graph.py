"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """node, component (its smallest reachable node) of every node with an edge to another.

    ``edges`` has u and v (long). Each round links every node's neighbours to their least, first for larger then for
    smaller neighbours; it ends when a round changes nothing, and
    ``rounds`` without such an end is an error. Rounds are written tables, so they don't pile up lineage.
    A hub is a key of a two-sided join, which AQE splits.
    """
    now = scratch.write(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.write(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large, hubs = scratch.write(large, "large"), least
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b"))
        after = small.filter("a <> b").unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        after = scratch.write(after.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "stars")
        new = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        scratch.drop(large)
        scratch.drop(hubs)
        scratch.drop(now)
        now = after
        if mark == tuple(new):
            break
        mark = tuple(new)
    else:
        raise RuntimeError(f"components did not converge in {rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
