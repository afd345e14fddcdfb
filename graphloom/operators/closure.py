"""Reachability over an edge frame by frontier expansion; safe on cycles.

Each step joins the newest pairs with the edges and keeps what was not known,
so a pair is derived once; pairs so far are in the shared folder. Starting from
``seeds`` limits the work to what they reach.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.lineage import cut


#: Hops after which the pairs so far are written as one table.
FOLD = 8


def reachable(edges: DataFrame, seeds: DataFrame | None = None, max_hops: int | None = None) -> DataFrame:
    """(start, node, hops): every node that ``edges(src, dst)`` lead to in one hop or more, with the fewest hops.

    ``seeds(start)`` limits the starts. Repeated edges and cycles are harmless.
    """
    edges = edges.select("src", "dst").distinct()
    first = edges if seeds is None else edges.join(seeds.select(F.col("start").alias("src")).distinct(), "src", "left_semi")
    known = new = cut(first.select(F.col("src").alias("start"), F.col("dst").alias("node"), F.lit(1).alias("hops")))
    hops = 1
    while (max_hops is None or hops < max_hops) and not new.isEmpty():
        hops += 1
        step = new.select("start", F.col("node").alias("src")).join(edges, "src").select("start", F.col("dst").alias("node")).distinct()
        new = cut(step.join(known, ["start", "node"], "left_anti").withColumn("hops", F.lit(hops)))
        known = known.unionByName(new) if hops % FOLD else cut(known.unionByName(new))
    return known


def reflexive(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``reachable`` pairs and every node of ``nodes(node)`` with itself at 0 hops."""
    own = nodes.select(F.col("node").alias("start"), "node", F.lit(0).alias("hops")).distinct()
    return pairs.join(own, ["start", "node"], "left_anti").unionByName(own)


def subclass_closure(triples: DataFrame, predicate: str) -> DataFrame:
    """(start, node): reflexive-transitive closure of a schema predicate such as rdfs:subClassOf."""
    edges = triples.filter((F.col("p") == predicate) & (F.col("o_kind") != "lit")).select(F.col("s").alias("src"), F.col("o").alias("dst"))
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    return reflexive(reachable(edges), nodes).select("start", "node")
