"""Connected components by alternating large and small stars, with joins only.

The least neighbour of each node is counted with partial aggregation and written
before it is joined back.  So both sides of each join are plain shuffles, which
Spark splits where a centre has very many neighbours (or a broadcast, if small).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm import shared


def _large(e: DataFrame) -> DataFrame:
    """Links each greater neighbour of a node to the least node beside it (edges: u > v)."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = shared.cut(both.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m")).select("v", F.least("v", "m").alias("m")), "least")
    out = shared.cut(e.join(least, "v").select("u", F.col("m").alias("v")).where("u <> v"), "links")
    shared.drop(least)
    return out


def _small(e: DataFrame) -> DataFrame:
    """Links a node and its lesser neighbours to the least of these."""
    least = shared.cut(e.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = shared.cut(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
    shared.drop(least)
    return out


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node and root (the least node of its component) of every node of edges (columns a, b of long) but roots themselves.

    Repeated edges and loops are fine.  Rounds grow as the logarithm of the longest
    path.  Nothing reaches the driver but counts and a sum.
    """
    first = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    first = shared.cut(first, "links")
    e = _small(first)
    shared.drop(first)
    state = None
    for _ in range(most):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        # If every node is linked once, and no centre is itself linked, the stars are the components.
        if not now[0] or tuple(now) == state or now[0] == now[2] and not e.join(e.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = tuple(now)
        wide = _large(e)
        shared.drop(e)
        e = _small(wide)
        shared.drop(wide)
    raise RuntimeError("components did not settle")
