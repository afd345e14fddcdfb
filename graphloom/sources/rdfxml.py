"""RDF/XML, and reading files of any of the supported forms."""

from __future__ import annotations

import hashlib
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from graphloom.plans.parser import QueryError
from graphloom.sources.rdf import parse_turtle
from graphloom.terms import RDF, TRIPLE_FIELDS, TRIPLE_SCHEMA, TYPE

_R = f"{{{RDF}}}"
_XML = "{http://www.w3.org/XML/1998/namespace}"


def parse_rdfxml(text: str, name: str = "") -> list[tuple]:
    """Rows of the triples schema: node elements, property attributes, nested nodes, collections, literals."""
    tag = hashlib.sha1(name.encode()).hexdigest()[:8]
    rows: dict[tuple, None] = {}
    fresh = 0

    def bnode(label: str | None = None) -> tuple[str, str]:
        nonlocal fresh
        fresh += 1
        return (f"{tag}n{label}" if label else f"{tag}x{fresh}"), "bnode"

    def iri(qname: str) -> str:
        return qname[1:].replace("}", "", 1) if qname.startswith("{") else qname

    def resolve(ref: str, base: str) -> str:
        return base + ref if ref.startswith("#") or ref == "" else ref

    def add(s: tuple[str, str], p: str, o: tuple[str, str], datatype: str = "", lang: str = "") -> None:
        rows[s[0], p, o[0], s[1], o[1], datatype, lang] = None

    def node(e: ET.Element, base: str, lang: str) -> tuple[str, str]:
        base, lang = e.get(f"{_XML}base", base).rstrip("#") if e.get(f"{_XML}base") else base, e.get(f"{_XML}lang", lang)
        if (about := e.get(f"{_R}about")) is not None:
            s = (resolve(about, base), "iri")
        elif (own := e.get(f"{_R}ID")) is not None:
            s = (f"{base}#{own}", "iri")
        else:
            s = bnode(e.get(f"{_R}nodeID"))
        if e.tag != f"{_R}Description":
            add(s, TYPE, (iri(e.tag), "iri"))
        for k, v in e.attrib.items():
            if not k.startswith((_R, _XML)):
                add(s, iri(k), (v, "lit"), lang=lang)
        for child in e:
            prop(s, child, base, lang)
        return s

    def prop(s: tuple[str, str], e: ET.Element, base: str, lang: str) -> None:
        lang, p = e.get(f"{_XML}lang", lang), iri(e.tag)
        if (ref := e.get(f"{_R}resource")) is not None:
            add(s, p, (resolve(ref, base), "iri"))
        elif (label := e.get(f"{_R}nodeID")) is not None:
            add(s, p, bnode(label))
        elif e.get(f"{_R}parseType") == "Collection":
            cells = [bnode() for _ in e]
            add(s, p, cells[0] if cells else (RDF + "nil", "iri"))
            for k, (cell, item) in enumerate(zip(cells, e)):
                add(cell, RDF + "first", node(item, base, lang))
                add(cell, RDF + "rest", cells[k + 1] if k + 1 < len(cells) else (RDF + "nil", "iri"))
        elif e.get(f"{_R}parseType") == "Resource":
            inner = bnode()
            add(s, p, inner)
            for child in e:
                prop(inner, child, base, lang)
        elif len(e):
            add(s, p, node(e[0], base, lang))
        else:
            datatype = e.get(f"{_R}datatype", "")
            add(s, p, (e.text or "", "lit"), datatype, "" if datatype else lang)

    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise QueryError("syntax", str(e)) from e
    base, lang = root.get(f"{_XML}base", "").rstrip("#"), root.get(f"{_XML}lang", "")
    for e in root if root.tag == f"{_R}RDF" else [root]:
        node(e, base, lang)
    return list(rows)


def parse_any(text: str, name: str) -> list[tuple]:
    """By suffix first, then the other form: Turtle (and N-Triples) or RDF/XML."""
    forms = [parse_rdfxml, parse_turtle] if name.lower().endswith((".owl", ".rdf", ".xml")) or text.lstrip().startswith("<?xml") else [parse_turtle, parse_rdfxml]
    try:
        return forms[0](text, name)
    except QueryError as first:
        try:
            return forms[1](text, name)
        except QueryError:
            raise first from None


def read_rdf(spark: SparkSession, path: str, mode: str = "FAILFAST", glob: str = "*.{ttl,nt,n3,owl,rdf,xml}") -> DataFrame:
    """Triples of all matching files below ``path``, whatever their form, as a set; one task a file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(batches):
        for b in batches:
            for name, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                try:
                    rows = parse_any(raw.decode("utf-8", "replace"), name)
                except QueryError:
                    if mode == "FAILFAST":
                        raise
                    continue
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows)], TRIPLE_FIELDS)

    return files.mapInArrow(run, TRIPLE_SCHEMA).dropDuplicates()
