"""Connected components by alternating large and small stars.

Each round rewires every node to the least node it sees; rounds end when
nothing changes.  Every round is a table in the shared folder, and the one
before it is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").bitwiseAND(F.lit(0xFFFFFFFF)))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (u, v): root is the least node of its component."""
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs = stored(pairs, "links")
    seen = None
    while (state := _state(pairs)) != seen:
        seen = state
        # large star: the greater neighbours of a node go to the least one that it sees
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the lesser neighbours of a node and itself go to the least one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, pairs = pairs, stored(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "links")
        remove(before)
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
