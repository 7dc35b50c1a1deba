"""Connected components of a link table, by alternating large and small stars.

Each round is two aggregations and two equi-joins over the links that are left, so no task or driver ever holds a component. Minima are
aggregated before the shuffle; a node with very many links is split by adaptive skew joins, as the other side has one row for each node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def components(links: DataFrame) -> DataFrame:
    """(node, root) from links (a, b) of two long columns: root is the smallest node that can be reached. Nodes without links are absent."""
    e = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = checkpoint(e)
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = e.select(F.col("v").alias("x"), F.col("u").alias("y")).join(least, F.col("x") == F.col("w")).select(F.col("y").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = large.join(least, F.col("u") == F.col("w"))
        moved = small.where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        e = checkpoint(moved.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if now == state:
            break
        state = now
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
