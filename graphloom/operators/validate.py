"""Validation: every rule is a join or anti-join that gives issue rows (code, s, p, detail)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.closure import subclass_closure
from graphloom.operators.profile import types
from graphloom.terms import OWL, RDFS, SUBCLASS, SUBPROPERTY, TYPE, XSD

SCHEMA_TERMS = (RDFS, OWL, "http://www.w3.org/1999/02/22-rdf-syntax-ns#")


def issues(df: DataFrame, code: str, s: Column, p: Column, detail: Column, severity: str = "error") -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), s.alias("s"), p.alias("p"), detail.cast("string").alias("detail"))


def all_types(data: DataFrame, schema: DataFrame) -> DataFrame:
    """(s, cls): given classes and all their superclasses."""
    up = subclass_closure(schema, SUBCLASS)
    own = types(data)
    return own.unionByName(own.join(up.select(F.col("start").alias("cls"), F.col("node").alias("above")), "cls").select("s", F.col("above").alias("cls"))).distinct()


def links(schema: DataFrame, predicate: str) -> DataFrame:
    return schema.filter(F.col("p") == predicate).select(F.col("s").alias("p"), F.col("o").alias("want")).distinct()


def unknown_property(data: DataFrame, schema: DataFrame) -> DataFrame:
    declared = schema.filter((F.col("p") == TYPE) & F.col("o").isin(OWL + "ObjectProperty", OWL + "DatatypeProperty", OWL + "FunctionalProperty", "http://www.w3.org/1999/02/22-rdf-syntax-ns#Property"))
    used = data.filter(~reduce(lambda a, b: a | b, (F.col("p").startswith(n) for n in SCHEMA_TERMS))).groupBy("p").agg(F.count("*").alias("uses"))
    bad = used.join(declared.select(F.col("s").alias("p")).distinct(), "p", "left_anti")
    return issues(bad, "UNKNOWN_PROPERTY", F.lit(None).cast("string"), F.col("p"), F.col("uses"), "warning")


def property_type_mismatch(data: DataFrame, schema: DataFrame) -> DataFrame:
    """Literals on object properties, nodes on datatype properties."""
    kinds = schema.filter((F.col("p") == TYPE) & F.col("o").isin(OWL + "ObjectProperty", OWL + "DatatypeProperty")).select(F.col("s").alias("p"), F.col("o").alias("kind")).distinct()
    bad = data.join(kinds, "p").filter((F.col("kind") == OWL + "ObjectProperty") == (F.col("o_kind") == "lit"))
    return issues(bad, "PROPERTY_TYPE_MISMATCH", F.col("s"), F.col("p"), F.col("o"))


def effective(schema: DataFrame, predicate: str) -> DataFrame:
    """Domains or ranges, those of superproperties included."""
    up = subclass_closure(schema, SUBPROPERTY)
    own = links(schema, predicate)
    above = up.join(own.select(F.col("p").alias("node"), "want"), "node").select(F.col("start").alias("p"), "want")
    return own.unionByName(above).distinct()


def domain_violation(data: DataFrame, schema: DataFrame) -> DataFrame:
    """Subjects without a class that a predicate's domain asks for; untyped subjects have their own code."""
    used = data.select("s", "p").distinct().join(effective(schema, RDFS + "domain"), "p")
    fits = all_types(data, schema).select("s", F.col("cls").alias("want"))
    bad = used.join(fits, ["s", "want"], "left_anti").join(types(data).select("s").distinct().withColumn("typed", F.lit(True)), "s", "left")
    typed = F.coalesce("typed", F.lit(False))
    return issues(bad.filter(typed), "DOMAIN_VIOLATION", F.col("s"), F.col("p"), F.col("want")).unionByName(issues(bad.filter(~typed), "DOMAIN_UNTYPED", F.col("s"), F.col("p"), F.col("want"), "warning"))


def range_violation(data: DataFrame, schema: DataFrame) -> DataFrame:
    """Objects without a range's class, untyped objects, and literals of another datatype."""
    wants = effective(schema, RDFS + "range")
    used = data.filter(F.col("p") != TYPE).join(wants, "p")
    is_data = F.col("want").startswith(XSD)
    wrong = used.filter((F.col("o_kind") == "lit") & is_data & (F.when(F.coalesce("o_dt", F.lit("")) == "", XSD + "string").otherwise(F.col("o_dt")) != F.col("want")))
    nodes = used.filter((F.col("o_kind") != "lit") & ~is_data).select("s", "p", "o", "want")
    fits = all_types(data, schema).select(F.col("s").alias("o"), F.col("cls").alias("want"))
    bad = nodes.join(fits, ["o", "want"], "left_anti").join(types(data).select(F.col("s").alias("o")).distinct().withColumn("typed", F.lit(True)), "o", "left")
    typed = F.coalesce("typed", F.lit(False))
    return (
        issues(wrong, "RANGE_DT_VIOLATION", F.col("s"), F.col("p"), F.col("o"))
        .unionByName(issues(bad.filter(typed), "RANGE_VIOLATION", F.col("s"), F.col("p"), F.col("o")))
        .unionByName(issues(bad.filter(~typed), "RANGE_UNTYPED", F.col("s"), F.col("p"), F.col("o"), "warning"))
    )


def functional_violation(data: DataFrame, predicates: list[str] | DataFrame) -> DataFrame:
    """Nodes with more than one value of a functional predicate.

    Values are dealt by node over all shuffle partitions, once: no task holds groups before that, and the two groupings need no other shuffle.
    """
    used = data.filter(F.col("p").isin(predicates)) if isinstance(predicates, list) else data.join(predicates.select("p").distinct(), "p", "left_semi")
    n = int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = used.select("s", "p", "o", "o_kind", "o_dt", "o_lang").repartition(n, "s").distinct().groupBy("s", "p").agg(F.count("*").alias("n")).filter("n > 1")
    return issues(many, "FUNCTIONAL_VIOLATION", F.col("s"), F.col("p"), F.col("n"))


def cardinality_violation(data: DataFrame, cls: str, predicate: str, least: int = 0, most: int | None = None) -> DataFrame:
    """Members of a class with fewer or more values of a predicate than allowed."""
    members = types(data).filter(F.col("cls") == cls).select("s")
    counts = data.filter(F.col("p") == predicate).groupBy("s").agg(F.count("*").alias("n"))
    found = members.join(counts, "s", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    bad = found.filter((F.col("n") < least) | (F.col("n") > most if most is not None else F.lit(False)))
    return issues(bad, "CARDINALITY", F.col("s"), F.lit(predicate), F.col("n"))


def some_values_violation(data: DataFrame, schema: DataFrame, cls: str, predicate: str, target: str, every: bool = False) -> DataFrame:
    """Restrictions: some value (or, with ``every``, all values) of a predicate must be of a class."""
    members = types(data).filter(F.col("cls") == cls).select("s")
    values = data.filter(F.col("p") == predicate).select("s", "o")
    good = all_types(data, schema).filter(F.col("cls") == target).select(F.col("s").alias("o"))
    if every:
        bad = members.join(values, "s").join(good, "o", "left_anti")
        return issues(bad, "RESTRICTION_ALL", F.col("s"), F.lit(predicate), F.col("o"))
    bad = members.join(values.join(good, "o", "left_semi"), "s", "left_anti")
    return issues(bad, "RESTRICTION_SOME", F.col("s"), F.lit(predicate), F.lit(target))


@dataclass
class Shape:
    """One property shape: what values of ``path`` a node of ``target`` may have."""

    target: str
    path: str
    min_count: int | None = None
    max_count: int | None = None
    node_kind: str | None = None
    cls: str | None = None
    datatype: str | None = None
    min_inclusive: float | None = None
    any_of: tuple[Shape, ...] = ()


def check_shape(data: DataFrame, schema: DataFrame, shape: Shape) -> DataFrame:
    """Issues of one shape; classes include their subclasses' members."""
    members = all_types(data, schema).filter(F.col("cls") == shape.target).select("s").distinct()
    values = data.filter(F.col("p") == shape.path).join(members, "s", "left_semi")
    found = []
    if shape.min_count is not None or shape.max_count is not None:
        n = members.join(values.groupBy("s").agg(F.count("*").alias("n")), "s", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        if shape.min_count is not None:
            found.append(issues(n.filter(F.col("n") < shape.min_count), "SHAPE_MIN_COUNT", F.col("s"), F.lit(shape.path), F.col("n")))
        if shape.max_count is not None:
            found.append(issues(n.filter(F.col("n") > shape.max_count), "SHAPE_MAX_COUNT", F.col("s"), F.lit(shape.path), F.col("n")))

    def value_tests(x: Shape, code: str = "") -> list[tuple[str, DataFrame]]:
        out = []
        if x.node_kind:
            kinds = {"IRI": ["iri"], "Literal": ["lit"], "BlankNode": ["bnode"], "BlankNodeOrIRI": ["iri", "bnode"]}[x.node_kind]
            out.append(("SHAPE_NODE_KIND", values.filter(~F.col("o_kind").isin(kinds))))
        if x.datatype:
            given = F.when(F.coalesce("o_dt", F.lit("")) == "", XSD + "string").otherwise(F.col("o_dt"))
            out.append(("SHAPE_DATATYPE", values.filter((F.col("o_kind") != "lit") | (given != x.datatype))))
        if x.min_inclusive is not None:
            out.append(("SHAPE_MIN_INCLUSIVE", values.filter(F.coalesce(F.col("o").try_cast("double") < x.min_inclusive, F.lit(True)))))
        if x.cls:
            good = all_types(data, schema).filter(F.col("cls") == x.cls).select(F.col("s").alias("o"))
            out.append(("SHAPE_CLASS", values.join(good, "o", "left_anti")))
        return out

    for code, bad in value_tests(shape):
        found.append(issues(bad, code, F.col("s"), F.lit(shape.path), F.col("o")))
    if shape.any_of:  # a value must pass all tests of one alternative
        failing = None
        for alternative in shape.any_of:
            bad = [b.select("s", "o") for _, b in value_tests(alternative)]
            bad_values = reduce(DataFrame.unionByName, bad).distinct() if bad else values.select("s", "o").limit(0)
            failing = bad_values if failing is None else failing.join(bad_values, ["s", "o"], "left_semi")
        found.append(issues(failing, "SHAPE_OR", F.col("s"), F.lit(shape.path), F.col("o")))
    return reduce(DataFrame.unionByName, found)


def unknown_vocabulary(data: DataFrame, schema: DataFrame, namespaces: list[str]) -> DataFrame:
    """Predicates and classes neither declared nor in an allowed namespace."""
    used = data.select(F.col("p").alias("term"), F.lit("property").alias("role")).unionByName(data.filter(F.col("p") == TYPE).select(F.col("o").alias("term"), F.lit("class").alias("role")))
    allowed = reduce(lambda a, b: a | b, (F.col("term").startswith(n) for n in namespaces), F.lit(False))
    counted = used.filter(~allowed).groupBy("term", "role").agg(F.count("*").alias("uses"))
    return counted.join(schema.select(F.col("s").alias("term")).distinct(), "term", "left_anti")
