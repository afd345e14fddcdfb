"""Schema rules on every triple: domains and ranges of any of several classes, collections included, and the checklists made of them.

A property's expectations are the objects of rdfs:domain and schema:domainIncludes
(rdfs:range and schema:rangeIncludes) of itself and its superproperties, and the
members of any owl:unionOf list among them; one is enough. A class fits an
expectation it equals or is below, and so does one that is declared equivalent
to a class that does. Literals fit rdfs:Literal, their own datatype, schema:Text
(plain strings) and schema:URL (xsd:anyURI, or a scheme and a host).

Each side of a triple is judged once: the expectations are one row a property,
the classes one row a node, and a triple meets both by two joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.closure import subclass_closure
from graphloom.operators.collections import members
from graphloom.operators.lineage import cut
from graphloom.operators.profile import types
from graphloom.terms import OWL, RDFS, SCHEMA, SUBCLASS, SUBPROPERTY, TYPE, XSD

DOMAIN = [RDFS + "domain", SCHEMA + "domainIncludes"]
RANGE = [RDFS + "range", SCHEMA + "rangeIncludes"]
#: Predicates that are not judged.
ABOUT = [TYPE, SUBCLASS, SUBPROPERTY, RDFS + "domain", RDFS + "range"]
COLUMNS = ["severity", "code", "property", "subject", "object", "subject_types", "object_types", "object_datatype", "expected"]


def expectations(schema: DataFrame, predicates: list[str]) -> DataFrame:
    """(p, wants): what a property expects by any of the predicates, its superproperties' and the members of unions included."""
    said = schema.filter(F.col("p").isin(predicates) & (F.col("o_kind") != "lit")).select(F.col("s").alias("node"), F.col("o").alias("want")).distinct()
    unions = schema.filter(F.col("p") == OWL + "unionOf").select(F.col("s").alias("want"), F.col("o").alias("head"))
    needed = unions.join(said.select("want").distinct(), "want", "left_semi")
    listed = said.join(needed, "want").join(members(schema, needed), "head").select("node", F.col("item").alias("want"))
    all_ = said.unionByName(listed)
    up = subclass_closure(schema, SUBPROPERTY)
    above = up.join(all_, "node").select(F.col("start").alias("p"), "want")
    return all_.select(F.col("node").alias("p"), "want").unionByName(above).groupBy("p").agg(F.array_sort(F.collect_set("want")).alias("wants"))


def fitting(schema: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, above): every class that each of ``classes`` (cls) may stand for."""
    up = subclass_closure(schema, SUBCLASS).select(F.col("start").alias("cls"), F.col("node").alias("above"))
    same = schema.filter(F.col("p") == OWL + "equivalentClass").select(F.col("s").alias("cls"), F.col("o").alias("as"))
    same = same.unionByName(same.select(F.col("as").alias("cls"), F.col("cls").alias("as"))).distinct()
    via = same.unionByName(classes.select("cls", F.col("cls").alias("as"))).distinct()
    own = via.select("cls", F.col("as").alias("above"))
    return own.unionByName(via.join(up.select(F.col("cls").alias("as"), "above"), "as").select("cls", "above")).join(classes, "cls", "left_semi").distinct()


def literal_fits(datatype: Column, value: Column, wants: Column) -> Column:
    given = F.when(F.coalesce(datatype, F.lit("")) == "", F.lit(XSD + "string")).otherwise(datatype)
    url = (given == XSD + "anyURI") | value.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]")
    return (
        F.array_contains(wants, RDFS + "Literal")
        | (given.startswith(XSD) & F.array_contains(wants, given))
        | ((given == XSD + "string") & F.array_contains(wants, SCHEMA + "Text"))
        | (url & F.array_contains(wants, SCHEMA + "URL"))
    )


def check(data: DataFrame, schema: DataFrame) -> DataFrame:
    """Issue rows of every triple that is judged; a triple may have one about its subject and one about its object."""
    n = int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = cut(expectations(schema, DOMAIN).withColumnRenamed("wants", "domains").join(expectations(schema, RANGE).withColumnRenamed("wants", "ranges"), "p", "full"))
    # dealt by node once: repeats, classes and subjects meet in the same partitions
    own = types(data).select("s", "cls").repartition(n, "s").distinct()
    above = cut(fitting(schema, types(data).select("cls").distinct()))
    nodes = own.join(above, "cls").groupBy("s").agg(F.array_sort(F.collect_set("cls")).alias("types"), F.collect_set("above").alias("fits"))
    triple = ["s", "p", "o", "o_kind", "o_dt", "o_lang"]
    ranged = wanted.filter("ranges is not null").select("p", F.lit(True).alias("ranged"))
    judged = data.filter(~F.col("p").isin(ABOUT)).select(*triple).join(ranged, "p", "left")
    asks = F.col("ranged").isNotNull() & ~F.coalesce("o_kind", F.lit("")).isin("lit", "bnode")  # whose object's classes decide
    subjects = nodes.select("s", F.col("types").alias("s_types"), F.col("fits").alias("s_fits"))
    told = lambda rows: rows.select(*triple).repartition(n, "s").distinct().join(wanted, "p", "left").join(subjects, "s", "left")
    none = F.lit(None).cast("array<string>")
    linked = told(judged.filter(asks)).join(nodes.select(F.col("s").alias("o"), F.col("types").alias("o_types"), F.col("fits").alias("o_fits")), "o", "left")
    told = told(judged.filter(~asks)).withColumns({"o_types": none, "o_fits": none}).unionByName(linked)
    literal = F.col("o_kind") == "lit"
    about_s = (
        F.when(F.col("domains").isNull(), F.lit("domain_unknown"))
        .when(F.col("s_types").isNull(), F.lit("subject_untyped"))
        .when(~F.arrays_overlap("s_fits", "domains"), F.lit("domain_mismatch"))
    )
    about_o = (
        F.when(F.col("ranges").isNull(), F.lit("range_unknown"))
        .when(literal, F.when(~literal_fits(F.col("o_dt"), F.col("o"), F.col("ranges")), F.lit("range_mismatch_literal")))
        .when(F.col("o_kind") == "bnode", F.lit("blank_node_object"))
        .when(F.col("o_types").isNull(), F.lit("object_untyped"))
        .when(~F.arrays_overlap("o_fits", "ranges"), F.lit("range_mismatch_iri"))
    )
    joined = lambda c: F.coalesce(F.array_join(c, "|"), F.lit(""))
    both = F.array(F.struct(about_s.alias("code"), joined("domains").alias("expected")), F.struct(about_o.alias("code"), joined("ranges").alias("expected")))
    rows = told.withColumn("issue", F.explode(both)).filter("issue.code is not null")
    code = F.col("issue.code")
    severity = F.when(code.contains("unknown"), F.lit("info")).when(code.contains("mismatch"), F.lit("error")).otherwise(F.lit("warn"))
    only = lambda c, text: F.when(code == c, text).otherwise(F.lit(""))
    datatype = F.when(F.coalesce("o_dt", F.lit("")) == "", F.lit(XSD + "string")).otherwise(F.col("o_dt"))
    return rows.select(
        severity.alias("severity"),
        code.alias("code"),
        F.col("p").alias("property"),
        F.col("s").alias("subject"),
        F.col("o").alias("object"),
        only("domain_mismatch", joined("s_types")).alias("subject_types"),
        only("range_mismatch_iri", joined("o_types")).alias("object_types"),
        only("range_mismatch_literal", datatype).alias("object_datatype"),
        F.col("issue.expected").alias("expected"),
    )


def checklists(issues: DataFrame) -> dict[str, DataFrame]:
    """The six reports of ``check``'s rows by name."""
    of = lambda *codes: issues.filter(F.col("code").isin(*codes))
    subject = F.col("code") == "subject_untyped"
    return {
        "overview": issues.groupBy("property", "code").agg(F.count("*").alias("count")),
        "domain_mismatches": of("domain_mismatch").select("property", "subject", "subject_types", F.col("expected").alias("expected_domains")),
        "range_mismatches_iri": of("range_mismatch_iri").select("property", "object", "object_types", F.col("expected").alias("expected_ranges")),
        "range_mismatches_lit": of("range_mismatch_literal").select("property", "object", "object_datatype", F.col("expected").alias("expected_ranges")),
        "untyped_nodes": of("subject_untyped", "object_untyped").select(
            "code", "property", F.when(subject, F.lit("subject")).otherwise(F.lit("object")).alias("who"), F.when(subject, F.col("subject")).otherwise(F.col("object")).alias("node"), "expected"
        ),
        "missing_schema": of("domain_unknown", "range_unknown").groupBy("property", F.substring_index("code", "_", 1).alias("missing")).agg(F.count("*").alias("triples")),
    }


def write_checklists(issues: DataFrame, prefix: str) -> None:
    """Every report as CSV files under ``prefix``_name; the overview is sorted by falling count."""
    for name, report in checklists(issues).items():
        if name == "overview":
            report = report.orderBy(F.desc("count"), "property", "code").coalesce(1)
        report.write.mode("overwrite").option("header", True).csv(f"{prefix}_{name}")
