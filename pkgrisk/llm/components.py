"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgrisk.session import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node, root``: the smallest node that each end of an edge ``a, b`` reaches; nodes are numbers.

    Each round hangs every node under the smallest of its neighbours, first the larger neighbours, then the smaller ones.  The
    number of rounds grows with the logarithm of the longest chain, each round is written once, and nothing comes to the driver
    but the number of edges and a checksum.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now, before, n = scratch.save(edges, f"{name}-0"), None, 0
    while True:
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).head()
        if mark == before:
            break
        before, n = mark, n + 1
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("e"))
        now = scratch.save(small.select("e.a", "e.b").filter("a <> b").distinct(), f"{name}-{n}")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
