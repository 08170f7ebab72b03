"""Connected components of links, by alternating stars.

Each round hangs every node on the least node it knows: first the larger
neighbours of each node (large star), then the smaller ones (small star).  A
round is written to the shared folder; the rounds end when the links no longer
change, after about the logarithm of the longest chain.  Links never come to
the driver, only their count and the sum of their hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import drop_stash, stash


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _meet(rows: DataFrame, least: DataFrame) -> DataFrame:
    """``rows`` with the least neighbour of ``u``.  Both sides are written tables,
    so that Spark can broadcast the small one or split the rows of a hub."""
    return rows.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in a link (a, b); root is the least node of
    its component.  Nodes are of any type that sorts.  Null ends and links of a
    node to itself are left out, and equal links count once.  No links, no rows."""
    links = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = stash(links, "links")
    before = _state(links)
    while before[0]:
        both = links.union(links.select("v", "u"))
        least = stash(both.groupBy("u").agg(F.min("v").alias("m")), "least")
        large = stash(_meet(both, least).where("v > u").select(F.col("v").alias("u"), F.least("m", F.col("u")).alias("v")).distinct(), "large")
        lower = stash(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = _meet(large, lower).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stash(small.union(lower.select("u", F.col("m").alias("v"))).distinct(), "links")
        drop_stash(links, least, large, lower)
        links = after
        now = _state(links)
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select("v", "v").distinct())
