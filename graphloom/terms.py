"""The triples table and RDF terms as columns.

A triples frame has one row per (subject, predicate, object) and is a set. A
*term* is a struct of value, kind (``iri``, ``bnode``, ``lit``) and tag (the
datatype IRI of a literal, or ``@lang``; empty otherwise), so that equality of
structs is equality of terms.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SCHEMA = "http://schema.org/"
SKOS = "http://www.w3.org/2004/02/skos/core#"
EX = "http://example.org/"

TYPE, LABEL, SUBCLASS, SUBPROPERTY = RDF + "type", RDFS + "label", RDFS + "subClassOf", RDFS + "subPropertyOf"
NUMERIC = [XSD + t for t in ("integer", "decimal", "double", "float", "int", "long", "short", "nonNegativeInteger", "positiveInteger")]

TRIPLE_FIELDS = ["s", "p", "o", "s_kind", "o_kind", "o_dt", "o_lang"]
TRIPLE_SCHEMA = ", ".join(f"{c} string" for c in TRIPLE_FIELDS)


def union(*parts: DataFrame) -> DataFrame:
    """Set union of triples: equal triples of several sources are one."""
    return reduce(DataFrame.unionByName, (p.select(*TRIPLE_FIELDS) for p in parts)).dropDuplicates()


def statement(df: DataFrame, s: Column, p: str, o: Column, kind: str = "iri", datatype: str = "", lang: str = "") -> DataFrame:
    """One triple per row of ``df`` (rows without an object give none)."""
    columns = [s.cast("string"), F.lit(p), o.cast("string"), F.lit("iri"), F.lit(kind), F.lit(datatype), F.lit(lang)]
    out = df.select(*(c.alias(n) for c, n in zip(columns, TRIPLE_FIELDS)))
    return out.filter(F.col("o").isNotNull() & F.col("s").isNotNull())


def term(value: Column, kind: Column | str, tag: Column | str = "") -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    tag = F.lit(tag) if isinstance(tag, str) else tag
    return F.struct(value.alias("v"), kind.alias("k"), tag.alias("t"))


def object_term() -> Column:
    tag = F.when(F.col("o_lang") != "", F.concat(F.lit("@"), F.col("o_lang"))).otherwise(F.coalesce("o_dt", F.lit("")))
    return term(F.col("o"), F.col("o_kind"), tag)


def n3(t: Column) -> Column:
    """A term as it is written in Turtle with full IRIs; null stays null."""
    quoted = F.concat(F.lit('"'), F.replace(F.replace(F.replace(t["v"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    tail = F.when(t["t"] == "", F.lit("")).when(t["t"].startswith("@"), t["t"]).otherwise(F.concat(F.lit("^^<"), t["t"], F.lit(">")))
    return F.when(t.isNull(), F.lit(None)).when(t["k"] == "iri", F.concat(F.lit("<"), t["v"], F.lit(">"))).when(t["k"] == "bnode", F.concat(F.lit("_:"), t["v"])).otherwise(F.concat(quoted, tail))


def local_name(iri: Column) -> Column:
    """After the last ``#``, else after the last ``/``."""
    return F.when(iri.contains("#"), F.substring_index(iri, "#", -1)).otherwise(F.substring_index(iri, "/", -1))


def namespace(iri: Column) -> Column:
    return F.substring(iri, F.lit(1), F.length(iri) - F.length(local_name(iri)))


def curie(iri: Column, prefixes: dict[str, str]) -> Column:
    """``prefix:local`` by the longest matching namespace; the IRI itself where none matches."""
    out = iri
    for p, ns in sorted(prefixes.items(), key=lambda x: len(x[1])):
        out = F.when(iri.startswith(ns), F.concat(F.lit(p + ":"), F.substring(iri, F.lit(len(ns) + 1), F.length(iri)))).otherwise(out)
    return out


def humanise(iri: Column) -> Column:
    """A readable label: the local name with underscores and case changes as spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(local_name(iri), "[_-]+", " "), "(?<=[a-z0-9])(?=[A-Z])", " "))


def date_span(value: Column, datatype: Column) -> Column:
    """A (partial) date as struct<start, end>: first instant and last second of what it names.

    Accepts years, year-months, dates and date-times; null where it is none of these.
    """
    y = F.try_to_number(F.regexp_extract(value, r"^(-?\d{4})", 1), F.lit("9999")).cast("int")
    m = F.expr("try_cast(null as int)")
    m = F.when(value.rlike(r"^\d{4}-\d{2}"), F.substring(value, 6, 2).cast("int")).otherwise(m)
    d = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(value, 9, 2).cast("int"))
    exact = F.try_to_timestamp(F.regexp_replace(F.substring(value, 1, 19), "T", " "), F.lit("yyyy-MM-dd HH:mm:ss"))
    zero = F.lit(0)
    whole = lambda year, month, day: F.try_make_timestamp(year, month, day, zero, zero, zero)
    ending = lambda day: day + F.expr("interval 1 day") - F.expr("interval 1 second")
    month_end = F.to_timestamp(F.last_day(whole(y, m, F.lit(1))))
    start = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"), exact).otherwise(whole(y, F.coalesce(m, F.lit(1)), F.coalesce(d, F.lit(1))))
    end = (
        F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"), exact)
        .when(d.isNotNull(), ending(whole(y, m, d)))
        .when(m.isNotNull(), ending(month_end))
        .otherwise(ending(whole(y, F.lit(12), F.lit(31))))
    )
    good = value.rlike(r"^\d{4}(-\d{2}(-\d{2}([T ]\d{2}:\d{2}:\d{2}.*)?)?)?(Z|[+-]\d{2}:\d{2})?$")
    return F.when(good & start.isNotNull() & end.isNotNull(), F.struct(start.alias("start"), end.alias("end")))
