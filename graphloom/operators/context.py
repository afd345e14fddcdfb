"""Context of many sections of a graph at once: seeds, frontiers, growth, new sections, memberships, facts and lines.

A section is a set of nodes: rows (section, node). Edges are rows (src,
predicate, dst), labels rows (node, label). Every operator works on all sections
in one plan; none runs a job a section, and no section or frontier has to fit a
task: the best few of each are found by windows that drop the rest before they
are shuffled. Ties go to the smallest name. Sections without nodes in the graph
have no frontier, and empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.graph import both_ways, degree
from graphloom.operators.lineage import cut
from graphloom.operators.retrieve import keep_first
from graphloom.terms import LABEL, SCHEMA, local_name

# Weights of crossing edges by the local name of their predicate; any other weighs 1.
WEIGHTS = {
    "involvesMusicEnsemble": 1.6,
    "involvesMemberOfMusicEnsemble": 1.6,
    "member": 1.3,
    "isOriginalMember": 1.4,
    "recordingOf": 1.2,
    "hasPart": 1.2,
    "inAlbum": 1.0,
    "location": 1.1,
    "startDate": 0.8,
}
# What a degree adds to a score, matches of a seed label, longest line and shortest text kept.
PER_DEGREE, PER_LABEL, LONGEST, SHORTEST = 0.1, 5, 180, 12


def seeds(triples: DataFrame, entities: list[str] | None = None, labels: list[str] | None = None, query: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node): the entities as given; without any, nodes with one of the labels in any case (``PER_LABEL`` a label) and those that ``query`` gives as ``s``."""
    spark = triples.sparkSession
    if entities:
        return spark.createDataFrame([(e,) for e in entities], "node string").distinct()
    wanted = spark.createDataFrame([(x.lower(),) for x in labels or []], "wanted string").distinct()
    named = triples.filter((F.col("o_kind") == "lit") & (F.col("s_kind") == "iri") & F.col("p").isin(LABEL, SCHEMA + "name")).select(F.col("s").alias("node"), F.lower("o").alias("wanted"))
    place = F.row_number().over(Window.partitionBy("wanted").orderBy("node"))
    found = named.distinct().join(wanted, "wanted", "left_semi").withColumn("place", place).filter(F.col("place") <= PER_LABEL).select("node")
    if query is not None:
        found = found.unionByName(query(triples).select(F.col("s").alias("node")).filter("node is not null"))
    return found.distinct()


def readable(node: Column, label: Column) -> Column:
    """A label that is no address, else the local name with spaces; null for membership nodes, which have no name of their own."""
    local = local_name(node)
    return F.when((label != "") & ~label.startswith("http"), label).when(local.startswith("Membership_"), F.lit(None)).otherwise(F.replace(local, F.lit("_"), F.lit(" ")))


def names(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, name) of every node that has a readable name."""
    first = labels.groupBy("node").agg(F.min("label").alias("label"))
    told = nodes.select("node").distinct().join(first, "node", "left")
    return told.select("node", readable(F.col("node"), F.col("label")).alias("name")).filter("name is not null")


def inside(edges: DataFrame, sections: DataFrame) -> DataFrame:
    """(section, src, predicate, dst): each section's edges between its own nodes."""
    own = sections.select("section", "node").distinct()
    one = edges.select("src", "predicate", "dst").distinct().join(own.select("section", F.col("node").alias("src")), "src")
    return one.join(own.select("section", F.col("node").alias("dst")), ["section", "dst"], "left_semi").select("section", "src", "predicate", "dst")


def memberships(edges: DataFrame, labels: DataFrame, sections: DataFrame) -> DataFrame:
    """(section, hub, subject, predicate, object): membership nodes as one statement, the band, ``member`` with its date, and the person.

    Of several bands, persons or dates of a hub the smallest stands.
    """
    own = inside(edges, sections)
    local = local_name(F.col("predicate"))
    ends = lambda *words: F.min(F.when(F.greatest(*(local.contains(w).cast("int") for w in words), F.lit(0)) == 1, F.col("dst")))
    hubs = own.groupBy("section", F.col("src").alias("hub")).agg(ends("involvesMusicEnsemble").alias("band"), ends("involvesMemberOfMusicEnsemble").alias("person"), ends("startDate").alias("date"))
    hubs = hubs.filter("band is not null and person is not null")
    called = cut(names(hubs.select(F.explode(F.array("band", "person", "date")).alias("node")).filter("node is not null"), labels))
    for c in ("band", "person"):
        hubs = hubs.join(called.select(F.col("node").alias(c), F.col("name").alias(f"{c}_name")), c)
    dates = called.select(F.col("node").alias("date"), F.col("name").alias("since"))
    predicate = F.concat(F.lit("member"), F.when(F.col("since").isNotNull(), F.concat(F.lit(" (since "), "since", F.lit(")"))).otherwise(F.lit("")))
    return hubs.join(dates, "date", "left").select("section", "hub", F.col("band_name").alias("subject"), predicate.alias("predicate"), F.col("person_name").alias("object"))


def section_triples(edges: DataFrame, labels: DataFrame, sections: DataFrame, limit: int) -> DataFrame:
    """(section, place, subject, predicate, object): memberships first, then edges between readable nodes; each statement once, ``limit`` a section."""
    own = inside(edges, sections)
    called = cut(names(both_ways(own).select(F.col("src").alias("node")), labels))
    told = own.join(called.select(F.col("node").alias("src"), F.col("name").alias("subject")), "src").join(called.select(F.col("node").alias("dst"), F.col("name").alias("object")), "dst")
    told = told.select("section", F.lit(1).alias("kind"), "subject", local_name(F.col("predicate")).alias("predicate"), "object")
    members = memberships(edges, labels, sections).select("section", F.lit(0).alias("kind"), "subject", "predicate", "object")
    once = members.unionByName(told).groupBy("section", "subject", "predicate", "object").agg(F.min("kind").alias("kind"))
    place = F.row_number().over(Window.partitionBy("section").orderBy("kind", "subject", "predicate", "object"))
    return once.withColumn("place", place).filter(F.col("place") <= limit).select("section", "place", "subject", "predicate", "object")


def _weighed(edges: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(src, dst, weight) of every edge from both of its ends, the summed weights of parallel ones."""
    local, weight = local_name(F.col("predicate")), F.lit(1.0)
    for p, w in weights.items():
        weight = F.when((local == p) | (F.col("predicate") == p), F.lit(float(w))).otherwise(weight)
    told = edges.select("src", "dst", weight.alias("weight"))
    return told.unionByName(told.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).filter("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def frontiers(edges: DataFrame, sections: DataFrame, k: int, weights: dict[str, float] | None = None) -> DataFrame:
    """(section, node, score, rank): the ``k`` best nodes next to each section: the weights of the edges between, and a tenth of the node's degree."""
    own = sections.select("section", "node").distinct()
    crossing = _weighed(edges, WEIGHTS if weights is None else weights).join(own.select("section", F.col("node").alias("src")), "src")
    outside = crossing.groupBy("section", F.col("dst").alias("node")).agg(F.sum("weight").alias("weight")).join(own, ["section", "node"], "left_anti")
    score = F.round(F.col("weight") + PER_DEGREE * F.col("degree"), 9)
    scored = outside.join(degree(edges), "node").select("section", "node", score.alias("score"))
    rank = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("score"), "node"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def extra_facts(edges: DataFrame, sections: DataFrame, frontier: DataFrame, limit: int) -> DataFrame:
    """(section, place, src, predicate, dst): facts that a section's frontier (section, node, rank) adds.

    By rank of the node: first its edges with the section, then its others; each
    fact once and none that the section has itself, ``limit`` a section.
    """
    own = sections.select("section", "node").distinct()
    every = edges.select("src", "predicate", "dst").distinct()
    near = frontier.select("section", "node", "rank")
    out = every.join(near.withColumnRenamed("node", "src"), "src").withColumn("other", F.col("dst"))
    back = every.join(near.withColumnRenamed("node", "dst"), "dst").withColumn("other", F.col("src"))
    touched = own.select("section", F.col("node").alias("other"), F.lit(0).alias("kind"))
    told = out.unionByName(back).join(touched, ["section", "other"], "left").withColumn("kind", F.coalesce("kind", F.lit(1)))
    once = told.groupBy("section", "src", "predicate", "dst").agg(F.min(F.struct("rank", "kind")).alias("at"))
    place = F.row_number().over(Window.partitionBy("section").orderBy("at.rank", "at.kind", "src", "predicate", "dst"))
    return once.withColumn("place", place).filter(F.col("place") <= limit).select("section", "place", "src", "predicate", "dst")


def spawned(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """(section, node, origin): for each section with a frontier a new one of its best node and that node's neighbours.

    Sections that share their best node spawn it once, for the first of them.
    """
    best = frontier.filter("rank = 1").groupBy("node").agg(F.min("section").alias("section"))
    ego = both_ways(edges).join(best.select(F.col("node").alias("src"), "section"), "src").select("section", F.col("dst").alias("node"), F.col("src").alias("origin"))
    return ego.unionByName(best.select("section", "node", F.col("node").alias("origin"))).distinct().select(F.concat("section", F.lit("+")).alias("section"), "node", "origin")


def grow(edges: DataFrame, sections: DataFrame, budget: int, step: int = 8, weights: dict[str, float] | None = None) -> DataFrame:
    """(section, node, round): sections grown best first by up to ``budget`` nodes each, every node claimed by one section.

    A round takes each section's ``step`` best free neighbours, as many as its
    budget leaves; a node that several want goes to the one with the highest
    score, then the smallest name. Nodes of several sections from the start stay
    in all. Scores are carried from round to round: only edges of new nodes are
    joined. A round is three joins for all sections; there are about
    budget / step of them, more where sections compete.
    """
    links = cut(_weighed(edges, WEIGHTS if weights is None else weights))
    degrees = cut(degree(edges))
    members = cut(sections.select("section", "node").distinct().withColumn("round", F.lit(0)))
    taken = members.select("node").distinct()
    left = cut(members.select("section").distinct().withColumn("left", F.lit(budget)))
    new, waiting, rounds = members, None, 0
    while True:
        rounds += 1
        reached = links.join(new.select("section", F.col("node").alias("src")), "src").select("section", F.col("dst").alias("node"), "weight")
        waiting = reached if waiting is None else waiting.unionByName(reached)
        waiting = cut(waiting.groupBy("section", "node").agg(F.sum("weight").alias("weight")).join(taken, "node", "left_anti"))
        score = F.round(F.col("weight") + PER_DEGREE * F.col("degree"), 9)
        scored = waiting.join(left.filter("left > 0"), "section").join(degrees, "node").withColumn("score", score)
        rank = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("score"), "node"))
        wished = scored.withColumn("rank", rank).filter(F.col("rank") <= F.least(F.lit(step), F.col("left")))
        won = wished.groupBy("node").agg(F.min(F.struct((-F.col("score")).alias("score"), F.col("section").alias("section")))["section"].alias("section"))
        new = cut(won.select("section", "node", F.lit(rounds).alias("round")))
        if new.isEmpty():
            return members
        members = cut(members.unionByName(new))
        taken = members.select("node").distinct()
        used = new.groupBy("section").agg(F.count("*").cast("int").alias("used"))
        left = cut(left.join(used, "section", "left").select("section", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left")))


def outline_by_communities(edges: DataFrame, communities: DataFrame, labels: DataFrame, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """(section, node) of the ``n`` largest communities, and (section, beat): the names of their three best connected readable nodes."""
    size = communities.groupBy("community").agg(F.count("*").alias("size"))
    top = size.withColumn("place", F.row_number().over(Window.orderBy(F.desc("size"), "community"))).filter(F.col("place") <= n)
    section = F.concat(F.lit("seg_"), F.lpad(F.col("place").cast("string"), 3, "0"))
    members = cut(communities.join(F.broadcast(cut(top)), "community").select(section.alias("section"), "place", "node"))
    called = members.join(names(members, labels), "node").join(degree(edges), "node", "left")
    rank = F.row_number().over(Window.partitionBy("section").orderBy(F.desc_nulls_last("degree"), "node"))
    best = called.withColumn("rank", rank).filter(F.col("rank") <= 3)
    title = best.groupBy("section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]), " / ").alias("beat"))
    beats = members.select("section", "place").distinct().join(title, "section", "left")
    return members.select("section", "node"), beats.select("section", F.coalesce("beat", F.concat(F.lit("Cluster "), F.col("place").cast("string"))).alias("beat"))


def paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_hops: int = 6) -> DataFrame:
    """(target, source, pos, node): a shortest path to each target from the first of ``sources`` (node, place) that reaches it.

    Of several shortest paths the one with the smallest node before each, seen from the target.
    """
    links = cut(both_ways(edges).filter("src <> dst").distinct())
    level = cut(sources.groupBy("node").agg(F.min("place").alias("place")).select(F.col("node").alias("source"), "place", "node", F.lit(0).alias("hops"), F.lit(None).cast("string").alias("before")))
    seen = level
    for hop in range(1, max_hops + 1):
        step = level.select("source", "place", F.col("node").alias("src")).join(links, "src").groupBy("source", "place", F.col("dst").alias("node")).agg(F.min("src").alias("before"))
        level = cut(step.join(seen.select("source", "node"), ["source", "node"], "left_anti").select("source", "place", "node", F.lit(hop).alias("hops"), "before"))
        if level.isEmpty():
            break
        seen = cut(seen.unionByName(level))
    reached = seen.join(targets.select(F.col("node").alias("target")).distinct(), F.col("node") == F.col("target"))
    first = cut(reached.groupBy("target").agg(F.min(F.struct("place", "source", "hops", "before")).alias("f")).select("target", "f.source", "f.hops", "f.before"))
    out = first.select("target", "source", F.col("hops").alias("pos"), F.col("target").alias("node"))
    back = first.filter("before is not null").select("target", "source", (F.col("hops") - 1).alias("pos"), F.col("before").alias("node"))
    for _ in range(max_hops):
        back = cut(back)
        if back.isEmpty():
            break
        out = out.unionByName(back)
        back = back.join(seen.select("source", "node", "before"), ["source", "node"]).filter("before is not null").select("target", "source", (F.col("pos") - 1).alias("pos"), F.col("before").alias("node"))
    return out


def _tidy(text: Column) -> Column:
    """Straight quotes, no marks of literals, single spaces."""
    straight = F.translate(F.coalesce(text, F.lit("")), "“”’", "\"\"'")
    return F.trim(F.regexp_replace(F.regexp_replace(straight, r"\blit::[A-Za-z0-9]+\b", ""), r"\s+", " "))


def exploded(evidence: DataFrame) -> DataFrame:
    """(section, pos, line) from evidence (section, pos, type, value): one statement a line.

    A neighbourhood text is split at its dashes and keeps its whole statements;
    triples stay where they are whole, facts as they are, other texts where they
    are whole statements or long enough. Long lines end at a word; a line that
    the section has in any case is dropped.
    """
    value, kind = _tidy(F.col("value")), F.lower(F.coalesce("type", F.lit("")))
    whole = lambda c: c.rlike("^[^→]+→[^→]+→[^→]+$")
    told = evidence.select("section", "pos", kind.alias("kind"), value.alias("value")).filter("value <> ''")
    blob = F.lower("value").startswith("graph neighborhood:")
    parts = F.filter(F.transform(F.split(F.trim(F.substring("value", 20, 1 << 30)), r"\s-\s+"), lambda x: F.trim(F.regexp_replace(x, "^- ", ""))), whole)
    v = F.col("value")
    own = F.when(F.col("kind") == "triple", whole(v)).when(F.col("kind") == "fact", F.lit(True)).otherwise(whole(v) | (F.length(v) >= SHORTEST))
    lines = F.when(blob, parts).when(own, F.array(v)).otherwise(F.array().cast("array<string>"))
    rows = told.select("section", "pos", F.posexplode(lines).alias("at", "line"))
    start = F.substring("line", 1, LONGEST)
    shortened = F.concat(F.when(start.contains(" "), F.regexp_replace(start, r" [^ ]*$", "")).otherwise(start), F.lit("…"))
    cut_ = rows.withColumn("line", F.when(F.length("line") > LONGEST, shortened).otherwise(F.col("line")))
    first = keep_first(cut_, F.struct("section", F.lower("line")), [F.col("pos"), F.col("at")])
    place = F.row_number().over(Window.partitionBy("section").orderBy("pos", "at"))
    return first.select("section", place.alias("pos"), "line")
