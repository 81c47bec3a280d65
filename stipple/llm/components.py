"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stipple.llm.common import cut, drop


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The component of every node of a link between two different nodes: ``node`` and ``comp``, its least node.

    Links are undirected and may repeat; those with a null end, or of a node with itself, count as none.  Each round
    hangs nodes on the least of their neighbours, first those above a node, then those below, until nothing moves;
    rounds grow with the logarithm of the longest path.  Every round is one aggregation that combines before its
    shuffle, and one join, and is written, so that the plan stays short.
    """
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        # large star: a node's greater neighbours hang on its least neighbour
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its lesser neighbours hang on the least of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        after = cut(small)
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit(0x7FFFFFFF))), F.bit_xor(F.xxhash64("v", "u"))).first()
        drop(edges)
        edges = after
        if state == before or not state[0]:
            break
        before = state
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
    out._stipple_path = edges._stipple_path  # drop(out) deletes what it reads
    return out
