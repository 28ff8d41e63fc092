"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentsec.llm.common import materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One half step over distinct (a, b) with a > b. The minimum of each node's neighbours is a partial aggregate,
    written out; the join back to the links can split a hub."""
    both = edges.union(edges.select(F.col("b"), F.col("a"))) if large else edges
    least = materialize(both.groupBy(F.col("a").alias("hub")).agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
    linked = (both.filter("b > a") if large else both).join(least, F.col("a") == F.col("hub"))
    found = linked.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        found = found.union(least.select(F.col("hub"), F.col("m")))
    return found.filter("a <> b").distinct()


def components(links: DataFrame, most: int = 100) -> DataFrame:
    """(node, component): for every node of links (a, b bigint), the smallest node it is linked with.

    The number of steps grows with the logarithm of the longest chain. Each step is written to the shared folder."""
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    sign = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = sign(edges)
    for _ in range(most if before[0] else 0):
        edges = materialize(_stars(materialize(_stars(edges, True), "stars"), False), "stars")
        if (now := sign(edges)) == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components are not stable after {most} steps")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())
