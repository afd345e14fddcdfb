"""Connected components of an edge table by alternating large and small stars.

Each round is a pair of grouped minima and joins; its edges are written to the
shared folder. Nothing but two numbers a round comes to the driver. Returns
(node, root): every node that has an edge and is not its component's smallest
node, with that smallest node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, few, release


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    edges = cut(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges", few(pairs.sparkSession))
    seen = None
    while True:
        sign = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == seen or not sign[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen, old = sign, edges
        edges = cut(_small(_large(old)), "edges", few(pairs.sparkSession))
        release(old)
