"""Curation of triples: merge, normalise, resolve, rewrite, filter, reify, split, compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.profile import types
from graphloom.terms import LABEL, SCHEMA, TRIPLE_FIELDS, TYPE, XSD, date_span, statement, union


def normalise_schema_org(t: DataFrame, subjects: bool = False) -> DataFrame:
    """https://schema.org/ becomes http://schema.org/ in predicates and IRI objects (and subjects where asked)."""
    fix = lambda c: F.regexp_replace(c, "^https://schema\\.org/", SCHEMA)
    out = t.withColumns({"p": fix(F.col("p")), "o": F.when(F.col("o_kind") == "iri", fix(F.col("o"))).otherwise(F.col("o"))})
    return (out.withColumn("s", fix(F.col("s"))) if subjects else out).dropDuplicates(TRIPLE_FIELDS)


def canonical_map(members: DataFrame, degrees: DataFrame) -> DataFrame:
    """(node, canonical): of each ``members(key, node)`` group the node with most triples, the smallest IRI of equals.

    Groups are reduced by an aggregate, so a group of any size costs no single task more than its combiners.
    """
    ranked = members.join(degrees, "node", "left").withColumn("rank", F.struct((-F.coalesce("degree", F.lit(0))).alias("d"), F.col("node").alias("n")))
    best = ranked.groupBy("key").agg(F.min("rank")["n"].alias("canonical"), F.count("*").alias("size")).filter("size > 1")
    return members.join(best, "key").filter("node <> canonical").select("node", "canonical")


def degrees(t: DataFrame) -> DataFrame:
    ends = t.select(F.col("s").alias("node")).unionByName(t.filter(F.col("o_kind") != "lit").select(F.col("o").alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def rewrite(t: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace nodes by ``mapping(node, canonical)`` in subjects and IRI objects; the result is a set."""
    s = t.join(mapping.select(F.col("node").alias("s"), F.col("canonical").alias("__s")), "s", "left")
    o = s.join(mapping.select(F.col("node").alias("__n"), F.col("canonical").alias("__o")), (F.col("o") == F.col("__n")) & (F.col("o_kind") != "lit"), "left")
    fixed = o.withColumns({"s": F.coalesce("__s", "s"), "o": F.coalesce("__o", "o")})
    return fixed.select(*TRIPLE_FIELDS).dropDuplicates()


def dedupe_nodes(t: DataFrame, cls: str, keys: list[str]) -> DataFrame:
    """Merge members of a class that agree on the values of all ``keys`` predicates."""
    members = types(t).filter(F.col("cls") == cls).select("s")
    values = t.filter(F.col("p").isin(keys)).join(members, "s", "left_semi").groupBy("s").agg(*(F.min(F.when(F.col("p") == k, F.col("o"))).alias(f"k{i}") for i, k in enumerate(keys)))
    full = values.dropna().select(F.concat_ws("\x1f", *(f"k{i}" for i in range(len(keys)))).alias("key"), F.col("s").alias("node"))
    return rewrite(t, canonical_map(full, degrees(t)))


def dedupe_by_pattern(t: DataFrame, predicate: str, pattern: str) -> DataFrame:
    """Merge subjects whose ``predicate`` objects hold the same id, the first group of ``pattern``."""
    ids = t.filter(F.col("p") == predicate).select(F.regexp_extract("o", pattern, 1).alias("key"), F.col("s").alias("node")).filter("key <> ''").distinct()
    return rewrite(t, canonical_map(ids, degrees(t)))


def skolemise(t: DataFrame, prefix: str) -> DataFrame:
    """Blank nodes become IRIs named by the hash of what they say; equal ones become one."""
    own = t.filter(F.col("s_kind") == "bnode").groupBy("s").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "p", F.when(F.col("o_kind") == "bnode", "_").otherwise(F.col("o"))))), "\n").alias("text"))
    names = own.select(F.col("s").alias("node"), F.concat(F.lit(prefix), F.substring(F.sha1("text"), 1, 12)).alias("canonical"))
    out = rewrite(t, names)
    named = lambda c: F.when(F.col(c).startswith(prefix), "iri")
    return out.withColumns({"s_kind": F.coalesce(named("s"), "s_kind"), "o_kind": F.coalesce(F.when(F.col("o_kind") == "bnode", named("o")), "o_kind")})


def unique_names(nodes: DataFrame, slug: Column) -> DataFrame:
    """(node, name): slugs, with _2, _3, ... where several nodes share one, in IRI order."""
    ranked = nodes.withColumn("__slug", slug).withColumn("__r", F.row_number().over(Window.partitionBy("__slug").orderBy("node")))
    return ranked.select("node", F.when(F.col("__r") == 1, F.col("__slug")).otherwise(F.concat_ws("_", "__slug", F.col("__r").cast("string"))).alias("name"))


def slug(c: Column) -> Column:
    """Lower-case letters and digits, everything else as single hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def pascal_slug(c: Column) -> Column:
    return F.replace(F.initcap(F.trim(F.regexp_replace(c, "[^A-Za-z0-9]+", " "))), F.lit(" "), F.lit(""))


def keep_by_type(t: DataFrame, classes: DataFrame, max_loss: float | None = None) -> DataFrame:
    """Triples of subjects that have one of ``classes(cls)``; refuses if more than ``max_loss`` of the subjects would go."""
    keep = types(t).join(classes.select("cls").distinct(), "cls", "left_semi").select("s").distinct()
    if max_loss is not None:
        total, kept = t.select("s").distinct().count(), keep.count()
        if total and (total - kept) / total > max_loss:
            raise ValueError(f"{total - kept} of {total} subjects would be dropped")
    return t.join(keep, "s", "left_semi")


def split_by_type(t: DataFrame, cls: str) -> tuple[DataFrame, DataFrame]:
    """A class's members' triples, and all others."""
    own = types(t).filter(F.col("cls") == cls).select("s").distinct()
    return t.join(own, "s", "left_semi"), t.join(own, "s", "left_anti")


def allowed_objects(t: DataFrame, predicate: str, defined: DataFrame) -> DataFrame:
    """Drops ``predicate`` triples whose object is not in ``defined(node)``."""
    good = defined.select(F.col("node").alias("o"), F.lit(True).alias("__ok")).distinct()
    return t.join(good, "o", "left").filter((F.col("p") != predicate) | F.col("__ok")).select(*TRIPLE_FIELDS)


def missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` whose keys do not occur in ``new``."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti")


def backfill_names(t: DataFrame, source: str = LABEL, target: str = SCHEMA + "name", only_missing: bool = True) -> DataFrame:
    """``target`` triples from ``source`` triples, for nodes without one."""
    labels = t.filter(F.col("p") == source)
    if only_missing:
        labels = labels.join(t.filter(F.col("p") == target).select("s").distinct(), "s", "left_anti")
    return union(t, labels.withColumn("p", F.lit(target)))


def dates_to_intervals(t: DataFrame, start: str, end: str, interval: str, starts: str, ends: str) -> DataFrame:
    """Replace start and end dates of a node by an interval node with instants; partial dates span what they name."""
    old = t.filter(F.col("p").isin(start, end))
    spans = old.groupBy("s").agg(F.min(F.when(F.col("p") == start, date_span(F.col("o"), F.col("o_dt"))["start"])).alias("a"), F.max(F.when(F.col("p") == end, date_span(F.col("o"), F.col("o_dt"))["end"])).alias("b"))
    node, form = F.concat(F.col("s"), F.lit("_interval")), "yyyy-MM-dd'T'HH:mm:ss"
    return union(
        t.filter(~F.col("p").isin(start, end)),
        statement(spans, F.col("s"), interval, node),
        statement(spans, node, starts, F.date_format("a", form), "lit", XSD + "dateTime"),
        statement(spans, node, ends, F.date_format("b", form), "lit", XSD + "dateTime"),
    )


def split_roles(t: DataFrame, predicate: str, role_link: str, delimiters: str = "[,;/]") -> DataFrame:
    """One role node per distinct part of a literal, case ignored, in place of the literal."""
    parts = t.filter(F.col("p") == predicate).select("s", F.posexplode(F.split("o", delimiters)).alias("i", "role")).withColumn("role", F.trim("role")).filter("role <> ''")
    first = parts.groupBy("s", F.lower("role").alias("k")).agg(F.min_by("role", "i").alias("role"))
    node = F.concat(F.col("s"), F.lit("_role_"), slug(F.col("k")))
    return union(t.filter(F.col("p") != predicate), statement(first, F.col("s"), role_link, node), statement(first, node, LABEL, F.col("role"), "lit"))


def merge_with_provenance(rows: DataFrame) -> DataFrame:
    """Equal triples of ``rows(s, p, o, cq_ids, sources, status)`` as one, with all ids and sources, trimmed; invalid ones go."""
    clean = rows.withColumns({c: F.trim(c) for c in ("s", "p", "o")}).filter("s <> '' and p <> '' and o <> ''")
    joined = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return clean.groupBy("s", "p", "o").agg(joined("cq_ids"), joined("sources"), F.min("status").alias("status"))


def renumber(items: DataFrame, group: str, key: Column, position: Column) -> DataFrame:
    """Keep each group's first item per key and number what stays 1, 2, ... in order."""
    first = items.withColumns({"__k": key, "__p": position}).groupBy(group, "__k").agg(F.min("__p").alias("__p"))
    order = Window.partitionBy(group).orderBy(F.col("__p").asc_nulls_last(), "__k")
    return first.select(group, F.col("__k").alias("item"), F.row_number().over(order).cast("long").alias("position"))


def remove_cascade(t: DataFrame, nodes: DataFrame, along: list[str]) -> DataFrame:
    """Remove nodes, what points to them by the ``along`` predicates in turn, and every triple that names a removed node."""
    gone = nodes.select("node").distinct()
    layer = gone
    for p in along:
        layer = t.filter((F.col("p") == p) & (F.col("o_kind") != "lit")).join(layer.select(F.col("node").alias("o")), "o", "left_semi").select(F.col("s").alias("node")).distinct()
        gone = gone.unionByName(layer).distinct()
    left = t.join(gone.select(F.col("node").alias("s")), "s", "left_anti")
    dead = gone.select(F.col("node").alias("o"), F.lit(True).alias("__gone"))
    return left.join(dead, "o", "left").filter((F.col("o_kind") == "lit") | F.col("__gone").isNull()).select(*TRIPLE_FIELDS)


def dual_types(t: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds class ``c`` to every subject that has predicate ``p``, for each rule (p, c)."""
    return union(t, *(statement(t.filter(F.col("p") == p).select("s").distinct(), F.col("s"), TYPE, F.lit(c)) for p, c in rules))
