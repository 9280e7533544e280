"""Connected components of a graph given as a table of links.

Alternates the two star steps of Kiveris et al., "Connected Components in MapReduce and Beyond" (2014): every node links
its larger neighbours to its smallest neighbour, then its smaller ones. Both keep the components and shrink their
diameter, so a few rounds leave stars around each component's smallest node. A node with very many links is never
gathered: its smallest neighbour is an aggregate, and the join that brings it back may split the node's links.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Scratch


def connected_components(links: DataFrame, left: str, right: str, scratch: Scratch) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of every node that has a link to another node.

    Null ends and links of a node to itself count for nothing; repeated links count once.
    """
    table = scratch.keep(_ordered(links.select(F.col(left).alias("u"), F.col(right).alias("v"))), "links")
    before = _digest(table)
    while before[0]:
        table = scratch.keep(_small_star(_large_star(table)), "links")
        after = _digest(table)
        if after == before:
            break
        before = after
    # Each remaining link leads from a node to its component's smallest
    members = table.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(table.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _ordered(links: DataFrame) -> DataFrame:
    """Distinct links with ``u`` > ``v``."""
    return links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _digest(table: DataFrame) -> tuple:
    """Equal tables have equal digests; one row to the driver."""
    row = table.agg(
        F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("v", "u")), F.lit(0)),
    ).first()
    return tuple(row)


def _large_star(table: DataFrame) -> DataFrame:
    both = table.unionByName(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("w").alias("v")).where("u <> v").distinct()


def _small_star(table: DataFrame) -> DataFrame:
    """Every link leads from a larger ``u`` to a smaller ``v``."""
    least = table.groupBy("u").agg(F.min("v").alias("w"))
    moved = table.join(least, "u").where("v <> w").select(F.col("v").alias("u"), F.col("w").alias("v"))
    return moved.unionByName(least.select("u", F.col("w").alias("v"))).distinct()
