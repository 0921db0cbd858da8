"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the smallest node that is reachable.

    Alternating large-star and small-star steps: each node links its larger
    neighbours to its smallest one, then its smaller neighbours (and itself) to
    the smallest, until no edge changes.  Each round is written to the shared folder, so lineage stays short.
    Minima are pre-aggregated in the map tasks; only joins see a hub's edges.  A
    join's right side is aggregated by the same key, and adaptive execution splits
    a hub only where both sides come straight from an exchange, so the key is
    rewritten (to the same value) after the aggregate: that takes a second, small
    exchange.

    Nodes are integers; edges with a null end or of a node to itself are dropped,
    repeated edges count once.  Without edges the result is empty.
    """
    apart = F.expr("u | 0L").alias("u")

    now = scratch.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}0")
    before, k = None, 0
    while True:
        stat = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if stat == before:
            break
        before, k = stat, k + 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(apart, F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m")).select(apart, "m")
        small = large.join(smallest, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = scratch.write(small, f"{name}{k}")
        if k > 1:
            scratch.drop(f"{name}{k - 2}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
