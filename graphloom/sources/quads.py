"""TriG and JSON-LD: named graphs of triples from texts, and TriG lines of rows.

JSON-LD contexts are those inside the document (terms, prefixes, @vocab, @base,
@language, type coercion, @list, @set, @language and @reverse); one that has to
be fetched is an error, as is @nest. Blank nodes are named after the file.
"""

from __future__ import annotations

import hashlib
import json
import math
from urllib.parse import urljoin

from graphloom.plans.parser import QueryError, Term, Var
from graphloom.sources.rdf import Turtle
from graphloom.terms import RDF, XSD

TYPE, FIRST, REST, NIL = (RDF + x for x in ("type", "first", "rest", "nil"))
#: Prefix of the IRIs that blank nodes are written as: their labels hold across files.
BLANK = "urn:bnode:"


class TriG(Turtle):
    """Turtle with graphs: ``{ }``, ``<g> { }`` and ``GRAPH <g> { }``."""

    def quads(self) -> list[tuple]:
        """(graph or None, triple) of the document."""
        out: list[tuple] = []
        while self.peek()[0] != "end":
            if self.directive():
                continue
            graph, inside = None, self.peek()[1] == "{"
            if self.is_word("GRAPH"):
                self.at += 1
                graph, inside = self.node([]), True
            elif self.peek(1)[1] == "{" and self.peek()[0] in ("iri", "pname", "bnode"):
                graph, inside = self.node([]), True
            found: list = []
            if inside:
                self.need("{")
                while not self.take("}"):
                    self.statement(found)
                    if not self.take(".") and self.peek()[1] != "}":
                        raise QueryError("syntax", f"expected '.' or '}}', found {self.peek()[1]!r}")
                self.take(".")
            else:
                self.statement(found)
                self.need(".")
            out += [(graph, t) for t in found]
        self.checked(t for _, t in out)
        return out


def _tag(name: str) -> str:
    return hashlib.sha1(name.encode()).hexdigest()[:8]


def parse_trig(text: str, name: str = "") -> list[tuple]:
    """Rows of the triples schema and a graph ("" is the default one)."""
    tag = _tag(name)

    def place(x: Term | Var) -> tuple[str, str, str, str]:
        if isinstance(x, Var):
            return f"{tag}{x.name.strip('_')}", "bnode", "", ""
        if x.kind == "iri" and x.value.startswith(BLANK):
            return x.value.removeprefix(BLANK), "bnode", "", ""
        lang = x.tag[1:] if x.tag.startswith("@") else ""
        return x.value, x.kind, "" if lang else x.tag, lang

    rows = []
    for g, t in TriG(text, {"": ""}).quads():
        s, o = place(t.s), place(t.o)
        graph = "" if g is None else place(g)[0] if not isinstance(g, Var) else f"_:{place(g)[0]}"
        rows.append((s[0], t.p.args[0], o[0], s[1], o[1], o[2], o[3], graph))
    return list(dict.fromkeys(rows))


class Context:
    """What names stand for at one place of a JSON-LD document."""

    def __init__(self, base: str = ""):
        self.base, self.vocab, self.language = base, None, ""
        self.terms: dict[str, dict | None] = {}

    def within(self, given) -> Context:
        """This context with ``@context`` entries applied."""
        out = Context(self.base)
        out.vocab, out.language, out.terms = self.vocab, self.language, dict(self.terms)
        for one in given if isinstance(given, list) else [given]:
            if one is None:
                out = Context(self.base)
            elif isinstance(one, str):
                raise QueryError("context", f"a context would have to be fetched: {one}")
            else:
                if "@base" in one:
                    out.base = urljoin(out.base, one["@base"]) if one["@base"] else ""
                if "@vocab" in one:
                    out.vocab = one["@vocab"]
                if "@language" in one:
                    out.language = (one["@language"] or "").lower()
                for k, v in one.items():
                    if not k.startswith("@"):
                        out.terms[k] = {"@id": v} if isinstance(v, str) else v
        return out

    def iri(self, name: str, vocab: bool, seen: tuple = ()) -> str | None:
        """Full form of a name; null where a term has none."""
        if name.startswith("@"):
            return name
        if vocab and name in self.terms and name not in seen:
            entry = self.terms[name]
            if entry is None:
                return None
            to = entry.get("@id", entry.get("@reverse", name))
            return None if to is None else self.iri(to, True, (*seen, name)) if to != name else self._compact(name, vocab, (*seen, name))
        return self._compact(name, vocab, seen)

    def _compact(self, name: str, vocab: bool, seen: tuple) -> str | None:
        prefix, colon, rest = name.partition(":")
        if colon:
            if prefix != "_" and not rest.startswith("//") and prefix in self.terms and prefix not in seen:
                return (self.iri(prefix, True, (*seen, prefix)) or "") + rest if self.terms[prefix] is None else self.iri(self.terms[prefix].get("@id", prefix), True, (*seen, prefix)) + rest
            return name
        if vocab:
            return self.vocab + name if self.vocab is not None else None
        return urljoin(self.base, name) if self.base else name


def _double(x: float) -> str:
    """As XML Schema writes doubles: one digit before the point, an exponent."""
    if x == 0:
        return "0.0E0"
    digits, _, exponent = f"{x:.15E}".partition("E")
    digits = digits.rstrip("0")
    return f"{digits}{'0' if digits.endswith('.') else ''}E{int(exponent)}"


class JsonLd:
    def __init__(self, name: str):
        self.tag, self.fresh, self.rows = _tag(name), 0, {}

    def blank(self) -> tuple[str, str]:
        self.fresh += 1
        return f"{self.tag}x{self.fresh}", "bnode"

    def subject(self, iri: str) -> tuple[str, str]:
        return (f"{self.tag}b{iri[2:]}", "bnode") if iri.startswith("_:") else (iri, "iri")

    def add(self, graph: str, s: tuple, p: str, o: tuple) -> None:
        if ":" in p and not p.startswith("_:"):
            self.rows[s[0], p, o[0], s[1], *(o[1:] if len(o) == 4 else (o[1], "", "")), graph] = None

    def literal(self, v, ctx: Context, kind: str | None, language: str | None) -> tuple:
        lang = ctx.language if language is None else language
        if isinstance(v, bool):
            return "true" if v else "false", "lit", kind or XSD + "boolean", ""
        if isinstance(v, (int, float)):
            whole = isinstance(v, int) or (v == math.floor(v) and abs(v) < 1e21)
            if whole and kind != XSD + "double":
                return str(int(v)), "lit", kind or XSD + "integer", ""
            return _double(float(v)), "lit", kind or XSD + "double", ""
        return str(v), "lit", kind or "", "" if kind else lang

    def value(self, v, ctx: Context, entry: dict, graph: str) -> tuple | None:
        """The object that a value stands for; what it says itself is added."""
        if v is None:
            return None
        kind = entry.get("@type")
        if isinstance(v, dict):
            inner = ctx.within(v["@context"]) if "@context" in v else ctx
            keys = {inner.iri(k, True): k for k in v if k != "@context"}
            if "@value" in keys:
                if v[keys["@value"]] is None:
                    return None
                own = v.get(keys.get("@type", ""), None)
                return self.literal(v[keys["@value"]], inner, inner.iri(own, True) if own else None, (v.get(keys.get("@language", ""), "") or "").lower())
            if "@list" in keys:
                return self.listed(v[keys["@list"]], inner, entry, graph)
            return self.node(v, ctx, graph)
        if isinstance(v, str) and kind in ("@id", "@vocab"):
            iri = ctx.iri(v, kind == "@vocab")
            return None if iri is None else self.subject(iri if kind == "@id" or ":" in iri else ctx.iri(v, False))
        return self.literal(v, ctx, ctx.iri(kind, True) if kind and not kind.startswith("@") else None, (entry["@language"] or "").lower() if "@language" in entry else None)

    def listed(self, items, ctx: Context, entry: dict, graph: str) -> tuple:
        found = [o for x in (items if isinstance(items, list) else [items]) if (o := self.listed(x, ctx, entry, graph) if isinstance(x, list) else self.value(x, ctx, entry, graph)) is not None]
        cells = [self.blank() for _ in found]
        for i, (cell, o) in enumerate(zip(cells, found)):
            self.add(graph, cell, FIRST, o)
            self.add(graph, cell, REST, cells[i + 1] if i + 1 < len(cells) else (NIL, "iri"))
        return cells[0] if cells else (NIL, "iri")

    def node(self, node: dict, ctx: Context, graph: str) -> tuple:
        if "@context" in node:
            ctx = ctx.within(node["@context"])
        keys = {k: ctx.iri(k, True) for k in node if k != "@context"}
        named = next((node[k] for k, full in keys.items() if full == "@id"), None)
        s = self.subject(ctx.iri(named, False)) if named is not None else self.blank()
        for k, full in keys.items():
            v, entry = node[k], ctx.terms.get(k) or {}
            many = v if isinstance(v, list) else [v]
            if full is None or full in ("@id", "@index"):
                continue
            if full == "@type":
                for t in many:
                    if (iri := ctx.iri(t, True)) is not None:
                        self.add(graph, s, TYPE, self.subject(iri))
            elif full == "@graph":
                for x in many:
                    self.node(x, ctx, s[0] if s[1] == "iri" else f"_:{s[0]}")
            elif full == "@reverse":
                for p, subjects in v.items():
                    self.reversed(subjects, ctx, ctx.iri(p, True), s, graph)
            elif full == "@included":
                for x in many:
                    self.node(x, ctx, graph)
            elif full.startswith("@"):
                raise QueryError("keyword", f"{full} is not read")
            elif "@reverse" in entry:
                self.reversed(v, ctx, full, s, graph)
            elif entry.get("@container") == "@list":
                self.add(graph, s, full, self.listed(v, ctx, entry, graph))
            elif entry.get("@container") == "@language" and isinstance(v, dict):
                for lang, texts in v.items():
                    for x in texts if isinstance(texts, list) else [texts]:
                        if x is not None:
                            self.add(graph, s, full, (x, "lit", "", "" if lang == "@none" else lang.lower()))
            else:
                flat = [y for x in many for y in (x.get("@set") if isinstance(x, dict) and isinstance(x.get("@set"), list) else [x])]
                for x in flat:
                    if (o := self.value(x, ctx, entry, graph)) is not None:
                        self.add(graph, s, full, o)
        return s

    def reversed(self, subjects, ctx: Context, p: str | None, o: tuple, graph: str) -> None:
        for x in subjects if isinstance(subjects, list) else [subjects]:
            s = self.value(x, ctx, {"@type": "@id"}, graph)
            if s is not None and p is not None:
                self.add(graph, s[:2], p, o)


def parse_jsonld(text: str, name: str = "", base: str = "") -> list[tuple]:
    """Rows of the triples schema and a graph."""
    try:
        top = json.loads(text)
    except ValueError as e:
        raise QueryError("syntax", str(e)) from e
    out = JsonLd(name)
    try:
        for node in top if isinstance(top, list) else [top]:
            ctx = Context(base)
            only = isinstance(node, dict) and set(node) <= {"@context", "@graph"} and "@graph" in node
            if only:  # a document's graph without a name is the default one
                ctx = ctx.within(node["@context"]) if "@context" in node else ctx
                inner = node["@graph"]
                for x in inner if isinstance(inner, list) else [inner]:
                    out.node(x, ctx, "")
            else:
                out.node(node, ctx, "")
    except (AttributeError, KeyError, TypeError) as e:
        raise QueryError("syntax", f"no JSON-LD: {e}") from e
    return list(out.rows)


def trig_line(row) -> str:
    """One row (s, p, o, s_kind, o_kind, o_dt, o_lang, graph) as a line of TriG."""
    node = lambda v, kind: f"<{BLANK}{v}>" if kind == "bnode" else f"<{v}>"
    escaped = lambda v: v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r")
    s, p, o, s_kind, o_kind, dt, lang, graph = row
    if o_kind == "lit":
        said = f'"{escaped(o)}"' + (f"@{lang}" if lang else f"^^<{dt}>" if dt else "")
    else:
        said = node(o, o_kind)
    line = f"{node(s, s_kind)} <{p}> {said} ."
    if not graph:
        return line
    name = f"<{BLANK}{graph[2:]}>" if graph.startswith("_:") else f"<{graph}>"
    return f"{name} {{ {line} }}"
