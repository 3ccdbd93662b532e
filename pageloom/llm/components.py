"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is an aggregate and an equi-join whose sides Spark can split, so that a hub with most of the
edges is no single task. Every round is a written table: lineage stays short and a lost executor costs a
re-read. Rounds grow with the logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.session import stage


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("pmod(xxhash64(v, u), 1048573)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long → (node, label): for every node of an edge the smallest node that it can reach.

    Repeated, reversed and self edges are fine; rows with a null are left out; no edges give no rows.
    """
    stars = stage(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = _signature(stars)
    while before[0]:
        both = stars.unionAll(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large-star")
        parent = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(parent, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = stage(moved.unionAll(parent.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        now = _signature(stars)
        if now == before:
            break
        before = now
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(roots)
