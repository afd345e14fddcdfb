"""RDF collections: members of lists by pointer jumping, and what is wrong with lists.

``rdf:rest`` links are followed backwards: every list node first knows the node
before it, then twice as far back each round, until it knows the node its list
starts at and how far it is from there. A list of n members takes about log2 n
rounds, however many lists there are. Nodes whose way back is longer than all
nodes lie on or behind a cycle; they are reported, and a list that is entered at
one of them is found by expanding the frontier among these few, without positions.

Nodes shared by several lists belong to each of them; where several ways lead
from a start to a node, the shortest gives its position. Repeated triples count
once. A list may be entered at any of its nodes. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.closure import reachable, reflexive
from graphloom.operators.lineage import cut
from graphloom.terms import RDF

FIRST, REST, NIL = RDF + "first", RDF + "rest", RDF + "nil"


def ranked(triples: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(node, start, pos) of every list node that a start leads to, (node) of those on or behind a cycle, and the rounds it took."""
    rest = triples.filter((F.col("p") == REST) & (F.col("o_kind") != "lit")).select("s", F.col("o").alias("next")).distinct()
    nodes = triples.filter(F.col("p").isin(FIRST, REST)).select(F.col("s").alias("node")).distinct()
    back = rest.filter(F.col("next") != NIL).select(F.col("next").alias("node"), F.col("s").alias("back"))
    jumps = cut(nodes.join(back, "node", "left").withColumn("far", F.when(F.col("back").isNotNull(), F.lit(1).cast("long"))))
    done = jumps.filter("back is null").select("node", F.col("node").alias("start"), F.lit(0).cast("long").alias("pos"))
    left = jumps.filter("back is not null")
    n, rounds = jumps.count(), 0
    while 2**rounds <= n and not left.isEmpty():
        rounds += 1
        # who waits for a node that is done is done; who waits for one that waits looks twice as far back
        ended = left.join(done.select(F.col("node").alias("back"), "start", "pos"), "back").groupBy("node", "start").agg(F.min(F.col("far") + F.col("pos")).alias("pos"))
        onward = left.join(left.select(F.col("node").alias("back"), F.col("back").alias("further"), F.col("far").alias("more")), "back")
        left = cut(onward.groupBy("node", F.col("further").alias("back")).agg(F.min(F.col("far") + F.col("more")).alias("far")))
        done = cut(done.unionByName(ended).groupBy("node", "start").agg(F.min("pos").alias("pos")))
    # a way back that is longer than all nodes runs in a circle
    return done, left.select("node").distinct(), rounds


def members(triples: DataFrame, heads: DataFrame) -> DataFrame:
    """(head, pos, item, item_kind): the items of the lists that ``heads`` (head) begin, in order; pos is null where a list runs in a circle."""
    heads = heads.select("head").distinct()
    at, cyclic, _ = ranked(triples)
    items = triples.filter(F.col("p") == FIRST).select(F.col("s").alias("node"), F.col("o").alias("item"), F.col("o_kind").alias("item_kind")).distinct()
    round_ = cut(heads.join(cyclic.select(F.col("node").alias("head")), "head"))
    entered = heads.join(round_, "head", "left_anti").join(at.select(F.col("node").alias("head"), "start", F.col("pos").alias("since")), "head")
    straight = entered.join(at, "start").filter(F.col("pos") >= F.col("since")).select("head", (F.col("pos") - F.col("since")).alias("pos"), "node").distinct()
    links = triples.filter((F.col("p") == REST) & (F.col("o") != NIL)).select(F.col("s").alias("src"), F.col("o").alias("dst"))
    links = links.join(cyclic.select(F.col("node").alias("src")), "src")
    found = reflexive(reachable(links, round_.select(F.col("head").alias("start"))), round_.select(F.col("head").alias("node")))
    circle = found.select(F.col("start").alias("head"), F.lit(None).cast("long").alias("pos"), "node").distinct()
    return straight.unionByName(circle).join(items, "node").select("head", "pos", "item", "item_kind")


def list_issues(triples: DataFrame) -> DataFrame:
    """(code, node): LIST_CYCLE, LIST_FORKED (several rests), LIST_SHARED (several lists lead to it), LIST_OPEN (no rest), LIST_ITEM (not one first)."""
    nodes = triples.filter(F.col("p").isin(FIRST, REST)).select("s", "p", "o", "o_kind", "o_dt", "o_lang").distinct()
    told = nodes.groupBy(F.col("s").alias("node")).agg(*(F.sum((F.col("p") == p).cast("long")).alias(c) for p, c in ((FIRST, "firsts"), (REST, "rests"))))
    codes = F.array(
        F.when(F.col("rests") > 1, F.lit("LIST_FORKED")).when(F.col("rests") == 0, F.lit("LIST_OPEN")),
        F.when(F.col("firsts") != 1, F.lit("LIST_ITEM")),
    )
    own = told.select(F.explode(codes).alias("code"), "node").filter("code is not null")
    shared = nodes.filter((F.col("p") == REST) & (F.col("o") != NIL)).groupBy(F.col("o").alias("node")).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("LIST_SHARED").alias("code"), "node")
    return own.unionByName(shared).unionByName(ranked(triples)[1].select(F.lit("LIST_CYCLE").alias("code"), "node"))
