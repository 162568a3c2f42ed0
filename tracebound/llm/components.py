"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracebound.plans.lineage import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(u, v)``; the root is the smallest node id.

    Alternates large-star and small-star contraction: every node hands its larger, then its
    smaller neighbours to the least node it knows. The number of edges never grows, a round is
    a fixed number of shuffles, and rounds grow with the logarithm of the longest chain. Only a
    count and a checksum reach the driver. Self-loops and repeated edges are allowed; a node
    that only has a self-loop is not returned. Null ids are ignored.
    """
    now = cut(
        edges.filter("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.filter("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lower, "u").filter("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(lower.select("u", F.col("m").alias("v"))).distinct()
        )
        now = cut(small)
        before, seen = seen, _state(now)
        if before == seen:
            break
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)),
        F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 30))),
        F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31))),
    ).first()
    return tuple(x or 0 for x in row)
