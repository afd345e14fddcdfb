"""RDF files as triples, and triples as files.

N-Triples are lines, so they are read with built-in text functions and split
like any other text. Turtle declares prefixes per file, so each file is parsed
by one task, many files in parallel; prefixes are never shared between files.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.parser import Parser, Path, QueryError, Term, Triple, Var
from graphloom.terms import TRIPLE_FIELDS, TRIPLE_SCHEMA, n3, object_term, term


class Turtle(Parser):
    """Statements of a Turtle document, with the grammar of triple patterns."""

    def directive(self) -> bool:
        """Take a prefix or base declaration, if one comes."""
        text = self.peek()[1]
        if text.lower() not in ("@prefix", "prefix", "@base", "base"):
            return False
        self.at += 1
        if text.lower().endswith("prefix"):
            prefix = self.next()[1]
            self.prefixes[prefix[:-1]] = self.iri()
        else:
            self.base = self.next()[1][1:-1]
        self.take(".")
        return True

    def statement(self, out: list[Triple]) -> None:
        """A subject and what is said of it."""
        start = self.at
        s = self.node(out)
        if not (self.tokens[start][1] in "[(" and self.peek()[1] in (".", "}")):
            self.properties(s, out)

    def checked(self, found) -> None:
        for t in found:
            if not isinstance(t.p, Path) or t.p.op != "pred":
                raise QueryError("syntax", "a predicate must be an IRI")

    def triples(self) -> list[Triple]:
        out: list[Triple] = []
        while self.peek()[0] != "end":
            if not self.directive():
                self.statement(out)
                self.need(".")
        self.checked(out)
        return out


def parse_turtle(text: str, name: str = "") -> list[tuple]:
    """Rows of the triples schema; blank nodes are named after the file and their place in it."""
    tag = hashlib.sha1(name.encode()).hexdigest()[:8]

    def place(x) -> tuple[str, str, str, str]:
        if isinstance(x, Var):
            return f"{tag}{x.name.strip('_')}", "bnode", "", ""
        lang = x.tag[1:] if x.tag.startswith("@") else ""
        return x.value, x.kind, "" if lang else x.tag, lang

    rows = []
    for t in Turtle(text, {"": ""}).triples():
        s, o = place(t.s), place(t.o)
        rows.append((s[0], t.p.args[0], o[0], s[1], o[1], o[2], o[3]))
    return list(dict.fromkeys(rows))


def read_turtle(spark: SparkSession, path: str, mode: str = "FAILFAST", glob: str = "*.ttl") -> DataFrame:
    """Triples of all matching files below ``path``, a set. ``PERMISSIVE`` leaves files out that do not parse."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(batches):
        for b in batches:
            for name, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                try:
                    rows = parse_turtle(raw.decode("utf-8", "replace"), name)
                except QueryError:
                    if mode == "FAILFAST":
                        raise
                    continue
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows)], TRIPLE_FIELDS)

    return files.mapInArrow(run, TRIPLE_SCHEMA).dropDuplicates()


_LINE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)\s*\.\s*(?:#.*)?$'


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Triples of N-Triples files, a set; lines that are none are left out."""
    lines = spark.read.text(path).filter(F.col("value").rlike(_LINE))
    part = lambda k: F.regexp_extract("value", _LINE, k)
    s, o = part(1), part(3)
    bare = lambda c: F.when(c.startswith("<"), F.substring(c, F.lit(2), F.length(c) - 2)).otherwise(F.substring(c, F.lit(3), F.length(c)))
    kind = lambda c: F.when(c.startswith("<"), "iri").when(c.startswith("_:"), "bnode").otherwise("lit")
    inner = F.regexp_extract(o, r'^"((?:[^"\\]|\\.)*)"', 1)
    for escape, char in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ('\\"', '"'), ("\\\\", "\\")):
        inner = F.replace(inner, F.lit(escape), F.lit(char))
    is_lit = o.startswith('"')
    out = lines.select(
        bare(s).alias("s"), part(2).alias("p"), F.when(is_lit, inner).otherwise(bare(o)).alias("o"), kind(s).alias("s_kind"), kind(o).alias("o_kind"),
        F.when(is_lit, F.regexp_extract(o, r"\^\^<([^>]*)>$", 1)).otherwise("").alias("o_dt"), F.when(is_lit, F.regexp_extract(o, r'"@([A-Za-z0-9-]+)$', 1)).otherwise("").alias("o_lang"),
    )
    return out.dropDuplicates()


def as_lines(t: DataFrame) -> DataFrame:
    """One N-Triples line per triple."""
    return t.select(F.concat_ws(" ", n3(term(F.col("s"), F.col("s_kind"))), F.concat(F.lit("<"), "p", F.lit(">")), n3(object_term()), F.lit(".")).alias("value"))


def write_ntriples(t: DataFrame, path: str) -> None:
    as_lines(t).write.mode("overwrite").text(path)


def write_grouped(t: DataFrame, path: str) -> None:
    """Turtle text with one block per subject, its statements in order and joined by semicolons."""
    said = F.concat(F.lit("<"), "p", F.lit("> "), n3(object_term()))
    blocks = t.groupBy(n3(term(F.col("s"), F.col("s_kind"))).alias("s")).agg(F.array_join(F.array_sort(F.collect_set(said)), " ;\n    ").alias("body"))
    blocks.select(F.concat("s", F.lit("\n    "), "body", F.lit(" .\n")).alias("value")).write.mode("overwrite").text(path)


def write_dot(edges: DataFrame, path: str) -> None:
    """A digraph of ``edges(src, predicate, dst)``; lines in one file, in order."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit("'")), F.lit('"'))
    body = edges.select(F.format_string("  %s -> %s [label=%s];", quote("src"), quote("dst"), quote("predicate")).alias("value"), F.lit(1).alias("k"))
    ends = edges.sparkSession.createDataFrame([("digraph g {", 0), ("}", 2)], "value string, k int")
    body.unionByName(ends).repartitionByRange(1, "k").sortWithinPartitions("k", "value").select("value").write.mode("overwrite").text(path)


_PREFIX = re.compile(r"@?prefix\s+schema1?:\s*<https?://schema\.org/>", re.IGNORECASE)


def normalise_text(text: str) -> str:
    """Turtle text with http://schema.org/ for https, and schema1: for that namespace only where needed."""
    return re.sub(r"<https://schema\.org/", "<http://schema.org/", text)


__all__ = ["Term", "as_lines", "parse_turtle", "read_ntriples", "read_turtle", "write_dot", "write_grouped", "write_ntriples"]
