"""Graph retrieval over edges(src, predicate, dst): k hops, degrees, frontier, communities, paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.closure import reachable
from graphloom.operators.lineage import cut
from graphloom.operators.profile import types
from graphloom.terms import LABEL, SCHEMA, TYPE, local_name


def edges_of(t: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Edges between nodes; predicates filtered by IRI or local name."""
    e = t.filter((F.col("o_kind") != "lit") & (F.col("p") != TYPE)).select(F.col("s").alias("src"), F.col("p").alias("predicate"), F.col("o").alias("dst"))
    named = lambda names: F.col("predicate").isin(names) | local_name(F.col("predicate")).isin(names)
    if include:
        e = e.filter(named(include))
    return e.filter(~named(exclude)) if exclude else e


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int, max_nodes: int | None = None) -> DataFrame:
    """(node, hop): nodes within ``hops`` of ``seeds(node)`` in either direction, with the fewest hops.

    ``max_nodes`` keeps the nearest, the smallest ids of equally near ones.
    """
    start = seeds.select("node").distinct()
    known = front = cut(start.withColumn("hop", F.lit(0)))
    links = both_ways(edges).distinct()
    for hop in range(1, hops + 1):
        step = links.join(front.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        front = cut(step.join(known, "node", "left_anti").withColumn("hop", F.lit(hop)))
        known = known.unionByName(front)
    return known.orderBy("hop", "node").limit(max_nodes) if max_nodes else known


def degree(edges: DataFrame) -> DataFrame:
    """Ends of edges at each node; parallel edges count."""
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def rank_frontier(edges: DataFrame, section: DataFrame, weights: dict[str, float], k: int, default: float = 1.0) -> DataFrame:
    """The ``k`` nodes outside ``section(node)`` with the heaviest crossing edges, a tenth of their degree added."""
    inside = section.select("node").distinct()
    weight = F.lit(default)
    for p, w in weights.items():
        weight = F.when(F.col("predicate") == p, w).otherwise(weight)
    out = edges.join(inside.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node"), weight.alias("w"))
    back = edges.join(inside.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node"), weight.alias("w"))
    crossing = out.unionByName(back).join(inside, "node", "left_anti").groupBy("node").agg(F.sum("w").alias("w"))
    scored = crossing.join(degree(edges), "node").select("node", (F.col("w") + 0.1 * F.col("degree")).alias("score"))
    return scored.orderBy(F.desc("score"), "node").limit(k)


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, community): every node takes its neighbours' commonest label, the smallest of equals, ``rounds`` times.

    All nodes change at once, from their own ids as labels: the result does not depend on any order.
    """
    links = cut(both_ways(edges).filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n")))
    # numbers in the order of the names stand for them: groups of longs take a fraction of the memory
    names = cut(links.select(F.col("src").alias("node")).distinct().orderBy("node").withColumn("id", F.monotonically_increasing_id()))
    numbered = links.join(names.select(F.col("node").alias("src"), F.col("id").alias("a")), "src").join(names.select(F.col("node").alias("dst"), F.col("id").alias("b")), "dst")
    links = cut(numbered.select("a", "b", "n"))
    labels = names.select(F.col("id").alias("a"), F.col("id").alias("label"))
    # the most votes, then the smallest label, as one number: max() of it needs no sort
    span = F.lit(_SPAN).cast("decimal(20,0)")
    packed = (F.col("n").cast("decimal(18,0)") * span).cast("decimal(38,0)") + (F.lit(_SPAN - 1) - F.col("label")).cast("decimal(20,0)")
    for _ in range(rounds):
        votes = links.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a", "label").agg(F.sum("n").alias("n"))
        best = votes.select("a", packed.cast("decimal(38,0)").alias("m")).groupBy("a").agg(F.max("m").alias("m"))
        labels = cut(best.select("a", (F.lit(_SPAN - 1) - F.pmod("m", span).cast("long")).alias("label")))
    named = labels.join(names.select(F.col("id").alias("a"), "node"), "a").join(names.select(F.col("id").alias("label"), F.col("node").alias("community")), "label")
    return named.select("node", "community")


#: Above every number of a node: a partition's rows are numbered below 1 << 33, and partitions are fewer than 1 << 20.
_SPAN = 1 << 53


def keep_seed_community(labels: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes of the community that holds most seeds, the smallest label of equals."""
    best = labels.join(seeds.select("node").distinct(), "node", "left_semi").groupBy("community").count().orderBy(F.desc("count"), "community").limit(1)
    return labels.join(best, "community", "left_semi")


def shortest_paths(edges: DataFrame, sources: DataFrame, max_hops: int = 6) -> DataFrame:
    """(start, node, hops) in either direction."""
    return reachable(both_ways(edges), sources.select(F.col("node").alias("start")), max_hops)


def labels_of(t: DataFrame) -> DataFrame:
    """(node, label): rdfs:label, else schema:name, else the IRI's local name."""
    text = t.filter(F.col("o_kind") == "lit").filter(F.col("p").isin(LABEL, SCHEMA + "name"))
    best = text.groupBy(F.col("s").alias("node")).agg(F.min(F.struct((F.col("p") != LABEL).alias("r"), F.col("o").alias("o")))["o"].alias("label"))
    nodes = t.select(F.col("s").alias("node")).unionByName(t.filter(F.col("o_kind") != "lit").select(F.col("o").alias("node"))).distinct()
    return nodes.join(best, "node", "left").select("node", F.coalesce("label", local_name(F.col("node"))).alias("label"))


def section_summary(edges: DataFrame, section: DataFrame, n: int) -> DataFrame:
    """The section's ``n`` edges with the best connected ends."""
    inside = section.select("node").distinct()
    own = edges.join(inside.withColumnRenamed("node", "src"), "src", "left_semi").join(inside.withColumnRenamed("node", "dst"), "dst", "left_semi").distinct()
    d = degree(edges)
    scored = own.join(d.select(F.col("node").alias("src"), F.col("degree").alias("a")), "src").join(d.select(F.col("node").alias("dst"), F.col("degree").alias("b")), "dst")
    return scored.select("src", "predicate", "dst", (F.col("a") + F.col("b")).alias("weight")).orderBy(F.desc("weight"), "src", "predicate", "dst").limit(n)


def schema_outline(t: DataFrame) -> DataFrame:
    """Distinct (class, predicate, class) links, each node by its first class."""
    first = types(t).groupBy("s").agg(F.min("cls").alias("cls"))
    e = edges_of(t).join(first.select(F.col("s").alias("src"), F.col("cls").alias("a")), "src").join(first.select(F.col("s").alias("dst"), F.col("cls").alias("b")), "dst")
    return e.select("a", "predicate", "b").distinct()


def timeline(t: DataFrame, predicate: str) -> DataFrame:
    """(node, year) from a date predicate, nodes without a year left out."""
    year = F.regexp_extract("o", r"\b(1[0-9]{3}|20[0-9]{2})\b", 1)
    return t.filter(F.col("p") == predicate).select(F.col("s").alias("node"), year.alias("year")).filter("year <> ''")


def top_edges_per_predicate(edges: DataFrame, k: int) -> DataFrame:
    """Per predicate its ``k`` edges with the highest sum of degrees counted within the predicate."""
    src = edges.groupBy("predicate", "src").agg(F.count("*").alias("a"))
    dst = edges.groupBy("predicate", "dst").agg(F.count("*").alias("b"))
    scored = edges.distinct().join(src, ["predicate", "src"]).join(dst, ["predicate", "dst"]).withColumn("weight", F.col("a") + F.col("b"))
    order = Window.partitionBy("predicate").orderBy(F.desc("weight"), "src", "dst")
    return scored.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("src", "predicate", "dst", "weight")


def betweenness(edges: DataFrame, max_nodes: int = 2000, sources: DataFrame | None = None) -> DataFrame:
    """(node, betweenness), exact: in one task up to ``max_nodes`` nodes.

    Beyond, ends of trees are folded into the nodes they hang on (``fold_leaves``), which gives the scores of
    what is folded by counting; the core that is left takes one task or ``betweenness_by_frontiers``.
    ``sources``: see there.
    """
    links = both_ways(edges).filter("src <> dst").distinct()
    if sources is not None:
        return betweenness_by_frontiers(links, sources)
    if links.select("src").distinct().limit(max_nodes + 1).count() <= max_nodes:
        return _brandes(links.withColumn("w", F.lit(1.0))).select("node", "betweenness")
    nodes, links, folded = fold_leaves(links, max_nodes)
    weighted = links.join(nodes.select(F.col("node").alias("src"), "w"), "src")
    if links.select("src").distinct().limit(max_nodes + 1).count() <= max_nodes:
        core = _brandes(weighted)
    else:
        core = betweenness_by_frontiers(weighted, weighted=True)
    # a node that is left alone is all of its component
    core = nodes.join(core, "node", "left").select("node", "own", "pairs", F.coalesce("betweenness", F.lit(0.0)).alias("core"), F.coalesce("total", "w").alias("total"))
    known = cut(core)
    for part in reversed(folded):
        totals = known.select(F.col("node").alias("to"), "total")
        known = cut(known.unionByName(part.join(totals, "to").select("node", "own", "pairs", F.lit(0.0).alias("core"), "total")))
    return known.select("node", (F.col("pairs") + F.col("own") * (F.col("total") - 1 - F.col("own")) + F.col("core")).alias("betweenness"))


def fold_leaves(links: DataFrame, enough: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Fold nodes with one neighbour into it, round by round, until ``enough`` nodes are left or a round folds under a hundredth of them.

    Gives nodes(node, w, own, pairs) and links(src, dst) that are left, and per round (node, to, own, pairs) of
    what was folded. ``own``: nodes folded into the node; ``w``: itself and those; ``pairs``: pairs of those
    that only the node connects.
    """
    links = cut(links.select("src", "dst"))
    nodes = cut(links.select(F.col("src").alias("node")).distinct().select("node", F.lit(1.0).alias("w"), F.lit(0.0).alias("own"), F.lit(0.0).alias("pairs")))
    folded: list[DataFrame] = []
    while (n := nodes.count()) > enough:
        ends = cut(links.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.min("dst").alias("to")).filter("n = 1").select("node", "to"))
        # of two nodes with only each other the smaller stays
        last = ends.join(ends.select(F.col("to").alias("node"), F.col("node").alias("to")), ["node", "to"], "left_semi").filter(F.col("node") < F.col("to"))
        gone = cut(ends.join(last.select("node"), "node", "left_anti").join(nodes, "node"))
        if gone.count() * 100 < n:
            break
        gained = gone.groupBy(F.col("to").alias("node")).agg(F.sum("w").alias("a"), F.sum(F.col("w") * F.col("w")).alias("q"))
        a = F.coalesce("a", F.lit(0.0))
        more = F.col("own") * a + (a * a - F.coalesce("q", F.lit(0.0))) / 2
        left = nodes.join(gone.select("node"), "node", "left_anti").join(gained, "node", "left")
        nodes = cut(left.select("node", (F.col("w") + a).alias("w"), (F.col("own") + a).alias("own"), (F.col("pairs") + more).alias("pairs")))
        links = cut(links.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
        folded.append(gone.select("node", "to", "own", "pairs"))
    return nodes, links, folded


def _brandes(links: DataFrame) -> DataFrame:
    """(node, betweenness, total) in one task; ``links`` hold (src, dst, w), the nodes that src stands for; ``total`` of its component."""

    def run(pdf):
        import pandas as pd

        out: dict[str, list[str]] = {}
        for a, b in zip(pdf["src"], pdf["dst"]):
            out.setdefault(a, []).append(b)
        weight = dict(zip(pdf["src"], pdf["w"]))
        score, total = dict.fromkeys(out, 0.0), {}
        for s in out:
            seen, ways, order, before = {s: 0}, {s: 1.0}, [s], {}
            for v in order:
                for w in out[v]:
                    if w not in seen:
                        seen[w], ways[w] = seen[v] + 1, 0.0
                        order.append(w)
                    if seen[w] == seen[v] + 1:
                        ways[w] += ways[v]
                        before.setdefault(w, []).append(v)
            total[s] = sum(weight[v] for v in order)
            share = dict.fromkeys(order, 0.0)
            for w in reversed(order):
                for v in before.get(w, ()):
                    share[v] += ways[v] / ways[w] * (weight[w] + share[w])
                if w != s:
                    score[w] += weight[s] * share[w] / 2
        return pd.DataFrame({"node": list(score), "betweenness": list(score.values()), "total": [total[s] for s in score]})

    return links.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(run, "node string, betweenness double, total double")


def betweenness_by_frontiers(links: DataFrame, sources: DataFrame | None = None, weighted: bool = False) -> DataFrame:
    """The same for graphs of any size: shortest paths from all sources at once, level by level, and back.

    ``links(src, dst)`` hold both directions, once each. A level is a join and a grouped sum, written to the
    shared folder. Exact scores need a row for every connected pair of a source and a
    node; ``sources(node)``, a sample of the nodes, bounds that: the scores are then
    sums over those sources only, to be scaled by the caller. ``weighted``: links have ``w``, the nodes
    that src stands for, and ``total`` of each node's component is given too.
    """
    links = cut(links.select("src", "dst", *(["w"] if weighted else [F.lit(1.0).alias("w")])))
    nodes = links.groupBy(F.col("src").alias("node")).agg(F.first("w").alias("w"))
    start = nodes if sources is None else sources.select("node").distinct().join(nodes, "node", "left_semi")
    level = cut(start.select(F.col("node").alias("s"), "node", F.lit(1.0).alias("ways")))
    levels = [level]
    while True:
        step = levels[-1].join(links, levels[-1]["node"] == links["src"]).groupBy("s", F.col("dst").alias("node")).agg(F.sum("ways").alias("ways"))
        # neighbours lie on this level, the one before or the next: only the last two can have been seen
        for old in levels[-2:]:
            step = step.join(old.select("s", "node"), ["s", "node"], "left_anti")
        step = cut(step)
        if step.isEmpty():
            break
        levels.append(step)
    share = levels[-1].select("s", "node", "ways", F.lit(0.0).alias("share"))
    out = [share]
    back_links = links.join(nodes.select(F.col("node").alias("dst"), F.col("w").alias("to_w")), "dst").select("src", "dst", "to_w") if weighted else links.select("src", "dst", F.lit(1.0).alias("to_w"))
    back_links = cut(back_links)
    for upper in reversed(levels[:-1]):
        back = share.select("s", F.col("node").alias("dst"), "share", "ways").join(back_links, "dst").select("s", "src", ((F.col("to_w") + F.col("share")) / F.col("ways")).alias("part"))
        parts = back.groupBy("s", F.col("src").alias("node")).agg(F.sum("part").alias("part"))
        share = cut(upper.join(parts, ["s", "node"], "left").select("s", "node", "ways", (F.col("ways") * F.coalesce("part", F.lit(0.0))).alias("share")))
        out.append(share)
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    from_ = nodes.select(F.col("node").alias("s"), F.col("w").alias("from_w"))
    scored = every.filter("s <> node").join(from_, "s") if weighted else every.filter("s <> node").withColumn("from_w", F.lit(1.0))
    scores = scored.groupBy("node").agg((F.sum(F.col("share") * F.col("from_w")) / 2).alias("betweenness"))
    result = nodes.join(scores, "node", "left").select("node", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))
    if not weighted:
        return result
    return result.join(every.join(nodes, "node").groupBy("s").agg(F.sum("w").alias("total")).withColumnRenamed("s", "node"), "node")
