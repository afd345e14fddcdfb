"""Deterministic parts of enrichment: ids in links, node reuse, memberships, claims of entity JSON, candidate slugs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.curate import slug
from graphloom.terms import LABEL, TYPE, XSD, statement, union


def external_ids(t: DataFrame, predicate: str, patterns: dict[str, str]) -> DataFrame:
    """One row per subject with an id from the links of ``predicate`` for each named pattern; the smallest of several."""
    found = [F.min(F.nullif(F.regexp_extract("o", p, 1), F.lit(""))).alias(n) for n, p in patterns.items()]
    return t.filter(F.col("p") == predicate).groupBy("s").agg(*found)


def first_by_priority(t: DataFrame, predicates: list[str], pattern: str = "(.+)") -> DataFrame:
    """(s, value): an id from the first predicate of the list that has one."""
    rank = F.lit(len(predicates))
    for i, p in enumerate(predicates):
        rank = F.when(F.col("p") == p, i).otherwise(rank)
    ids = t.filter(F.col("p").isin(predicates)).select("s", rank.alias("r"), F.regexp_extract("o", pattern, 1).alias("value")).filter("value <> ''")
    return ids.groupBy("s").agg(F.min(F.struct("r", "value"))["value"].alias("value"))


def reuse_or_mint(rows: DataFrame, known: DataFrame, prefix: str) -> DataFrame:
    """``rows(id, name)`` with a node each: that of ``known(id, node)``, else a new slug of the name, numbered until free."""
    matched = rows.join(known.select("id", "node").dropDuplicates(["id"]), "id", "left")
    base = F.concat(F.lit(prefix), slug(F.col("name")))
    taken = known.groupBy(F.regexp_replace("node", r"_\d+$", "").alias("base")).agg(F.count("*").alias("taken"))
    new = matched.filter("node is null").withColumn("base", base).join(taken, "base", "left")
    k = F.row_number().over(Window.partitionBy("base").orderBy("id")) + F.coalesce("taken", F.lit(0))
    minted = new.select("id", "name", F.when(k == 1, F.col("base")).otherwise(F.concat_ws("_", "base", k.cast("string"))).alias("node"))
    return matched.filter("node is not null").select("id", "name", "node").unionByName(minted)


def date_literal(value: Column) -> Column:
    """Datatype that a (partial) date has; empty where it is none."""
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), XSD + "date").when(value.rlike(r"^\d{4}-\d{2}$"), XSD + "gYearMonth").when(value.rlike(r"^\d{4}$"), XSD + "gYear").otherwise("")


def memberships(rows: DataFrame, ns: str) -> DataFrame:
    """Triples of ``rows(member, band, begin, end, instruments)``: a membership node with its ends, typed dates and distinct instruments."""
    node = F.concat(F.col("band"), F.lit("_member_"), F.substring(F.sha1(F.concat_ws(" ", "member", "begin", "end")), 1, 8))
    m = rows.withColumn("m", node)
    parts = [statement(m, F.col("m"), TYPE, F.lit(ns + "Membership")), statement(m, F.col("m"), ns + "member", F.col("member")), statement(m, F.col("m"), ns + "group", F.col("band"))]
    for c in ("begin", "end"):
        for kind in ("date", "gYearMonth", "gYear"):
            parts.append(statement(m.filter(date_literal(F.col(c)) == XSD + kind), F.col("m"), ns + c, F.col(c), "lit", XSD + kind))
    played = m.select("m", F.explode(F.array_distinct(F.transform("instruments", lambda i: F.lower(F.trim(i))))).alias("i")).filter("i <> ''")
    parts.append(statement(played, F.col("m"), ns + "instrument", F.col("i"), "lit"))
    return union(*parts)


def claims(entities: DataFrame, body: str, prop: str) -> DataFrame:
    """(entity, value): string values, or ids of item values, that entity JSON claims for a property."""
    v = F.parse_json(F.col(body))
    snaks = F.variant_get(v, f"$.claims.{prop}", "array<variant>")
    value = lambda x, path: F.try_variant_get(x, path, "string")
    out = entities.select("entity", F.explode(snaks).alias("x"))
    found = F.coalesce(value(F.col("x"), "$.mainsnak.datavalue.value.id"), value(F.col("x"), "$.mainsnak.datavalue.value"))
    return out.select("entity", found.alias("value")).filter("value is not null").distinct()


def candidate_slugs(title: Column, artist: Column) -> Column:
    """Url slugs that a song page may have, the likeliest first, each once: with and without what stands in brackets."""
    bare = F.regexp_replace(title, r"\s*[(\[][^)\]]*[)\]]", "")
    forms = F.array(F.concat_ws("-", slug(artist), slug(title)), F.concat_ws("-", slug(artist), slug(bare)), slug(bare))
    return F.array_distinct(F.filter(F.array(*(F.get(forms, F.lit(i)) for i in range(3))), lambda x: x != ""))


def label_map(t: DataFrame, values: DataFrame, predicate: str) -> DataFrame:
    """``values(label, value)`` attached as ``predicate`` literals to the nodes that carry the label, case ignored."""
    named = t.filter(F.col("p") == LABEL).select(F.lower("o").alias("l"), F.col("s").alias("node"))
    hits = values.select(F.lower("label").alias("l"), "value").join(named, "l")
    return statement(hits, F.col("node"), predicate, F.col("value"), "lit").dropDuplicates()
