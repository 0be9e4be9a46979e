"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgrid.llm.common import cut

MAX_ROUNDS = 50


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) of every node that has an edge.

    Each round points a node's larger neighbours, then its smaller ones, at the
    smallest it knows. Minima are aggregated and written before they are joined
    back, so that a hub's neighbours are an ordinary side of that join, which
    adaptive execution splits. Null ends and loops are ignored; repeated edges
    count once; no edges give no rows.
    """
    now = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = cut(now.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    state = None
    for _ in range(MAX_ROUNDS):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        told = large.join(low, "a")
        small = told.select("a", F.col("m").alias("b")).unionByName(told.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        now = cut(small.distinct())
        before, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    raise RuntimeError("components did not settle")
