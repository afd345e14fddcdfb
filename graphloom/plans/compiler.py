"""From the parsed query to a DataFrame plan.

Every variable is one column, a term struct, null where unbound. The compiler
tracks which variables a frame binds in every row: joins on those are plain
equi-joins that Spark plans by hash or merge; only variables that may be unbound
get the null-compatible condition of the algebra. Triple patterns are joined
constants first and connected before disconnected, by per-predicate counts where
they are given. Constants reach the scan as filters on s, p and o.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import terms as T
from graphloom.operators.closure import reachable
from graphloom.operators.lineage import cut
from graphloom.plans import parser as P

XSD = T.XSD


@dataclass
class Frame:
    """Solutions: ``df`` has one term column per variable; ``sure`` are bound in every row."""

    df: DataFrame | None  # None: the one empty solution
    sure: frozenset[str] = frozenset()
    maybe: frozenset[str] = frozenset()

    @property
    def names(self) -> list[str]:
        return sorted(self.sure | self.maybe)


def conjunction(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def constant(t: P.Term) -> Column:
    return T.term(F.lit(t.value), t.kind, t.tag)


# --- expressions -----------------------------------------------------------------


@dataclass
class Value:
    """A typed expression: ``kind`` is term, str, num, int, bool or date; null is unbound or an error."""

    kind: str
    col: Column

    def text(self) -> Column:
        if self.kind == "term":
            return self.col["v"]
        if self.kind == "num":
            return self.col.cast("string")
        return self.col.cast("string")

    def number(self) -> Column:
        if self.kind == "term":
            return F.when((self.col["k"] == "lit"), F.expr("0D") + self.col["v"].try_cast("double"))
        return self.col.cast("double") if self.kind in ("num", "int") else self.text().try_cast("double")

    def truth(self) -> Column:
        if self.kind == "bool":
            return self.col
        if self.kind in ("num", "int"):
            return self.col != 0
        if self.kind == "term":
            number = self.col["t"].isin(T.NUMERIC)
            return F.when(self.col["t"] == XSD + "boolean", self.col["v"].try_cast("boolean")).when(number, self.number() != 0).when(self.col["k"] == "lit", self.col["v"] != "")
        return self.col != ""

    def term(self) -> Column:
        tags = {"str": "", "num": XSD + "double", "int": XSD + "integer", "bool": XSD + "boolean", "date": XSD + "date"}
        if self.kind == "term":
            return self.col
        return F.when(self.col.isNotNull(), T.term(self.text(), "lit", tags[self.kind]))

    def plain(self) -> Column:
        """As a result column: terms give their lexical value."""
        return self.col["v"] if self.kind == "term" else self.col


def compare(op: str, a: Value, b: Value) -> Column:
    if op in ("=", "!="):
        if "num" in (a.kind, b.kind) or "int" in (a.kind, b.kind):
            same = a.number() == b.number()
        elif "bool" in (a.kind, b.kind):
            same = a.truth() == b.truth()
        elif a.kind == b.kind == "term":
            numeric = a.col["t"].isin(T.NUMERIC) & b.col["t"].isin(T.NUMERIC)
            plain = lambda x: F.when(x["t"] == XSD + "string", F.lit("")).otherwise(x["t"])
            same = F.when(numeric, a.number() == b.number()).otherwise((a.col["v"] == b.col["v"]) & (a.col["k"] == b.col["k"]) & (plain(a.col) == plain(b.col)))
        else:
            same = a.text() == b.text()
        return same if op == "=" else ~same
    if "num" in (a.kind, b.kind) or "int" in (a.kind, b.kind):
        x, y = a.number(), b.number()
    elif a.kind == b.kind == "term":
        numbers = a.col["t"].isin(T.NUMERIC) & b.col["t"].isin(T.NUMERIC)
        order = {"<": lambda p, q: p < q, ">": lambda p, q: p > q, "<=": lambda p, q: p <= q, ">=": lambda p, q: p >= q}[op]
        return F.when(numbers, order(a.number(), b.number())).otherwise(order(a.col["v"], b.col["v"]))
    else:
        x, y = a.text(), b.text()
    return {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]


class Compiler:
    """Compiles queries over one triples frame."""

    def __init__(self, triples: DataFrame, counts: dict[str, int] | None = None):
        self.triples, self.counts = triples, counts or {}
        self.spark: SparkSession = triples.sparkSession
        self.fresh = 0

    # --- frames ---
    def join(self, a: Frame, b: Frame, how: str = "inner", extra: Callable[[Frame], Column] | None = None) -> Frame:
        """Join of solutions; ``left`` keeps rows of ``a`` without a partner. ``extra`` is a condition on the joined row."""
        if a.df is None and not (how == "left" or extra):
            return b
        if a.df is None:
            a = Frame(self.spark.range(1).select(), frozenset(), frozenset())
        if b.df is None:
            return a
        shared = [n for n in a.names if n in b.names]
        right = b.df.select(*(F.col(n).alias(f"__r_{n}") for n in b.names))
        conditions = []
        for n in shared:
            same = F.col(n) == F.col(f"__r_{n}")
            if n in a.sure and n in b.sure:
                # terms are sorted by a number; their texts, which begin alike, decide among equal ones
                conditions += [F.xxhash64(n) == F.xxhash64(f"__r_{n}"), same]
            else:
                conditions.append(F.col(n).isNull() | F.col(f"__r_{n}").isNull() | same)
        merged = lambda n: F.coalesce(F.col(n), F.col(f"__r_{n}")) if n in a.names and n in b.names else F.col(n if n in a.names else f"__r_{n}")
        names = sorted({*a.names, *b.names})
        if extra:
            view = Frame(None, a.sure | b.sure, (a.maybe | b.maybe) - a.sure - b.sure)
            conditions.append(F.coalesce(extra(view, merged), F.lit(False)))
        df = a.df.join(right, conjunction(conditions), how) if conditions else a.df.crossJoin(right) if how == "inner" else a.df.join(right, F.lit(True), how)
        sure = a.sure | (b.sure if how == "inner" else frozenset())
        return Frame(df.select(*(merged(n).alias(n) for n in names)), sure, frozenset(names) - sure)

    def anti(self, a: Frame, b: Frame, how: str, extra: Callable | None = None, minus: bool = False) -> Frame:
        """Rows of ``a`` with (left_semi) or without (left_anti) a compatible row in ``b``."""
        if a.df is None:
            a = Frame(self.spark.range(1).select())
        shared = [n for n in a.names if n in b.names]
        if minus and not shared:
            return a
        right = b.df.select(*(F.col(n).alias(f"__r_{n}") for n in b.names))
        conditions, both = [], []
        for n in shared:
            same = F.col(n) == F.col(f"__r_{n}")
            both.append(F.col(n).isNotNull() & F.col(f"__r_{n}").isNotNull())
            conditions.append(same if n in a.sure and n in b.sure else F.col(n).isNull() | F.col(f"__r_{n}").isNull() | same)
        if minus and not any(n in a.sure and n in b.sure for n in shared):
            conditions.append(reduce(lambda x, y: x | y, both))
        if extra:
            merged = lambda n: F.col(n if n in a.names else f"__r_{n}")
            conditions.append(F.coalesce(extra(Frame(None, a.sure | b.sure, a.maybe | b.maybe), merged), F.lit(False)))
        return replace(a, df=a.df.join(right, conjunction(conditions), how))

    # --- patterns ---
    def new_name(self) -> str:
        self.fresh += 1
        return f"__p{self.fresh}"

    def scan(self, triple: P.Triple, predicates: list[str] | None) -> Frame:
        """One triple pattern with a predicate that is a constant, a list of them, or a variable."""
        df, names, filters = self.triples, {}, []
        if predicates is not None:
            filters.append(F.col("p") == predicates[0] if len(predicates) == 1 else F.col("p").isin(predicates))
        parts = [(triple.s, T.term(F.col("s"), F.col("s_kind"))), (triple.o, T.object_term())]
        if predicates is None:
            parts.append((triple.p, T.term(F.col("p"), "iri")))
        for place, col in parts:
            if isinstance(place, P.Term):
                column = "s" if place is triple.s and col is parts[0][1] else "o"
                filters.append(F.col(column) == place.value)
                if column == "s":
                    filters.append(F.col("s_kind") == place.kind)
                else:
                    filters.append(F.col("o_kind") == place.kind)
                    if place.kind == "lit":
                        lang = place.tag[1:] if place.tag.startswith("@") else ""
                        filters += [F.coalesce("o_lang", F.lit("")) == lang, F.coalesce("o_dt", F.lit("")) == ("" if lang else place.tag)]
            elif place.name in names:
                filters.append(names[place.name] == col)
            else:
                names[place.name] = col
        df = df.filter(conjunction(filters)).select(*(c.alias(n) for n, c in names.items()))
        return Frame(df, frozenset(names))

    def pattern(self, triple: P.Triple, around: Frame) -> Frame:
        """A triple pattern with any path."""
        p = triple.p
        if isinstance(p, P.Var):
            return self.scan(triple, None)
        if p.op == "pred":
            return self.scan(triple, [p.args[0]])
        if p.op == "inv":
            return self.pattern(P.Triple(triple.o, p.args[0], triple.s), around)
        if p.op == "alt":
            plain = [a.args[0] for a in p.args if a.op == "pred"]
            if len(plain) == len(p.args) == len(set(plain)):
                return self.scan(triple, plain)  # one scan; alternatives that repeat give their rows again
            return self.union([self.pattern(P.Triple(triple.s, a, triple.o), around) for a in p.args])
        if p.op == "seq":
            nodes = [triple.s, *(P.Var(self.new_name()) for _ in p.args[1:]), triple.o]
            return self.bgp([P.Triple(nodes[i], a, nodes[i + 1]) for i, a in enumerate(p.args)], around)
        return self.closure(triple, around)

    def closure(self, triple: P.Triple, around: Frame) -> Frame:
        """Path ``*``, ``+`` or ``?``: distinct pairs, from the side that is known."""
        p, step = triple.p, triple.p.args[0]
        a, b = P.Var("__src"), P.Var("__dst")
        start, end = triple.s, triple.o
        backward = isinstance(end, P.Term) and not isinstance(start, P.Term) or (
            isinstance(end, P.Var) and end.name in around.sure and not (isinstance(start, P.Term) or isinstance(start, P.Var) and start.name in around.sure)
        )
        if backward:
            start, end, step = end, start, P.Path("inv", (step,))
        edges = self.pattern(P.Triple(a, step, b), Frame(None)).df.select(F.col("__src").alias("src"), F.col("__dst").alias("dst"))
        if isinstance(start, P.Term):
            seeds = self.spark.range(1).select(constant(start).alias("start"))
        elif start.name in around.sure:
            seeds = cut(around.df.select(F.col(start.name).alias("start")).distinct())
        else:
            nodes = self.triples.select(T.term(F.col("s"), F.col("s_kind")).alias("start")).unionByName(self.triples.select(T.object_term().alias("start")))
            seeds = nodes.distinct() if p.op != "plus" else None
        pairs = reachable(edges, seeds, 1 if p.op == "opt" else None).select("start", "node")
        if p.op != "plus":
            pairs = pairs.unionByName(seeds.select("start", F.col("start").alias("node"))).distinct()
        names, filters = {}, []
        for place, col in ((start, F.col("start")), (end, F.col("node"))):
            if isinstance(place, P.Term):
                filters.append(col == constant(place))
            elif place.name in names:
                filters.append(names[place.name] == col)
            else:
                names[place.name] = col
        return Frame(pairs.filter(conjunction(filters)).select(*(c.alias(n) for n, c in names.items())), frozenset(names))

    def weight(self, triple: P.Triple, bound: frozenset[str]) -> tuple:
        """Rank for the join order: connected first, then most constants, then the rarest predicate."""
        variables = {x.name for x in (triple.s, triple.p, triple.o) if isinstance(x, P.Var)}
        constants = sum(isinstance(x, P.Term) for x in (triple.s, triple.o))
        heavy = isinstance(triple.p, P.Path) and triple.p.op in ("star", "plus", "opt")
        size = self.counts.get(triple.p.args[0], 0) if isinstance(triple.p, P.Path) and triple.p.op == "pred" else max(self.counts.values(), default=0)
        return (bool(bound) and not variables & bound, heavy, -constants - len(variables & bound), size)

    def bgp(self, triples: list[P.Triple], around: Frame) -> Frame:
        left, out = list(triples), Frame(None)
        while left:
            bound = out.sure | around.sure
            best = min(range(len(left)), key=lambda i: (*self.weight(left[i], bound), i))
            triple = left.pop(best)
            out = self.join(out, self.pattern(triple, out if out.df is not None else around))
        return out

    def union(self, frames: list[Frame]) -> Frame:
        frames = [f if f.df is not None else replace(f, df=self.spark.range(1).select()) for f in frames]
        df = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), (f.df.select(*f.names) for f in frames))
        sure = frozenset.intersection(*(f.sure for f in frames))
        return Frame(df, sure, frozenset().union(*(f.names for f in frames)) - sure)

    def values(self, part: P.Values) -> Frame:
        rows = [[None if t is None else (t.value, t.kind, t.tag) for t in row] for row in part.rows]
        schema = ", ".join(f"`{n}` struct<v:string,k:string,t:string>" for n in part.names)
        sure = frozenset(n for i, n in enumerate(part.names) if all(r[i] is not None for r in rows))
        return Frame(self.spark.createDataFrame(rows, schema), sure, frozenset(part.names) - sure)

    def group(self, group: P.Group, outer: dict[str, P.Term] | None = None) -> tuple[Frame, list]:
        """A group's solutions, and the filters that mention variables it does not bind."""
        top = outer is None
        out, filters, constants = Frame(None), [], dict(outer or {})
        swap = lambda x: constants.get(x.name, x) if isinstance(x, P.Var) else x

        def with_constants(f: Frame, used: set[str]) -> Frame:
            add = {n: t for n, t in constants.items() if n in used and n not in f.names}
            if not add:
                return f
            df = f.df if f.df is not None else self.spark.range(1).select()
            return Frame(df.withColumns({n: constant(t) for n, t in add.items()}), f.sure | frozenset(add), f.maybe)

        for part in group.parts:
            if isinstance(part, P.Bgp):
                used = {x.name for t in part.triples for x in (t.s, t.p, t.o) if isinstance(x, P.Var)}
                out = self.join(out, with_constants(self.bgp([P.Triple(swap(t.s), t.p, swap(t.o)) for t in part.triples], out), used))
            elif isinstance(part, P.Optional):
                inner, late = self.group(part.group, constants)
                out = self.join(out, inner, "left", self.condition(late) if late else None)
            elif isinstance(part, P.Union):
                branches = []
                for g in part.groups:
                    inner, late = self.group(g, constants)
                    branches.append(self.filtered(inner, late))
                out = self.join(out, self.union(branches))
            elif isinstance(part, P.Group):
                inner, late = self.group(part, constants)
                out = self.join(out, self.filtered(inner, late))
            elif isinstance(part, P.Minus):
                inner, late = self.group(part.group, constants)
                out = self.anti(out, self.filtered(inner, late), "left_anti", minus=True)
            elif isinstance(part, P.Values):
                out = self.join(out, self.values(part))
            elif isinstance(part, P.Bind):
                if isinstance(part.expr, P.Term) and part.var.name not in out.names:
                    constants[part.var.name] = part.expr
                    out = with_constants(out, {part.var.name}) if out.df is not None else out
                else:
                    out = with_constants(out, set(constants))
                    df = out.df if out.df is not None else self.spark.range(1).select()
                    value = self.value(part.expr, out, F.col).term()
                    out = Frame(df.withColumn(part.var.name, value), out.sure, out.maybe | {part.var.name})
            elif isinstance(part, P.LabelService):
                out = self.labels(out)
            elif isinstance(part, P.Filter):
                filters.append(part.expr)
        mine = {n: t for n, t in constants.items() if n not in (outer or {})}
        out = with_constants(out, set(mine))
        now = [f for f in filters if top or self.mentioned(f) <= set(out.names)]
        late = [f for f in filters if not any(f is x for x in now)]
        return self.filtered(out, now), late

    def labels(self, f: Frame) -> Frame:
        """Adds ``xLabel`` for each variable x that may be an IRI: its English or untagged label, else its IRI."""
        t = self.triples.filter((F.col("p") == T.LABEL) & F.coalesce("o_lang", F.lit("")).isin("", "en"))
        names = t.groupBy(F.col("s").alias("__iri")).agg(F.min("o").alias("__label"))
        out = f
        for n in f.names:
            if n + "Label" not in f.names:
                found = out.df.join(names, F.col(n)["v"] == F.col("__iri"), "left")
                label = T.term(F.coalesce("__label", F.col(n)["v"]), "lit")
                out = Frame(found.withColumn(n + "Label", F.when(F.col(n).isNotNull(), label)).drop("__iri", "__label"), out.sure, out.maybe | {n + "Label"})
        return out

    def mentioned(self, e: Any) -> set[str]:
        if isinstance(e, P.Var):
            return {e.name}
        if isinstance(e, P.Call):
            return set().union(*(self.mentioned(a) for a in e.args)) if e.args else set()
        return set()

    def condition(self, filters: list) -> Callable:
        return lambda frame, column: conjunction([self.value(f, frame, column).truth() for f in filters])

    def filtered(self, f: Frame, filters: list) -> Frame:
        for e in filters:
            if isinstance(e, P.Call) and e.name == "&&":
                f = self.filtered(f, list(e.args))
            elif isinstance(e, P.Exists) or isinstance(e, P.Call) and e.name == "!" and isinstance(e.args[0], P.Exists):
                exists = e if isinstance(e, P.Exists) else e.args[0]
                negated = exists.negated != (e is not exists)
                inner, late = self.group(exists.group, {})
                f = self.anti(f, inner, "left_anti" if negated else "left_semi", self.condition(late) if late else None)
            else:
                df = f.df if f.df is not None else self.spark.range(1).select()
                f = replace(f, df=df.filter(self.value(e, f, F.col).truth()))
        return f

    # --- expressions ---
    def value(self, e: Any, frame: Frame, column: Callable[[str], Column]) -> Value:
        if isinstance(e, P.Term):
            if e.kind == "lit" and e.tag in T.NUMERIC:
                whole = e.tag == XSD + "integer"
                return Value("int" if whole else "num", F.lit(int(e.value) if whole else float(e.value)))
            if e.kind == "lit" and e.tag == XSD + "boolean":
                return Value("bool", F.lit(e.value in ("true", "1")))
            return Value("term", constant(e))
        if isinstance(e, P.Var):
            if e.name not in frame.names:
                return Value("term", F.lit(None).cast("struct<v:string,k:string,t:string>"))
            return Value("term", column(e.name))
        if isinstance(e, P.Exists):
            raise P.QueryError("error", "EXISTS is supported as a filter of its own only")
        name = e.name
        if name in P.AGGREGATES:
            return self.aggregate(e, frame, column)
        args = [self.value(a, frame, column) for a in e.args]
        text = [a.text() for a in args]
        if name == "&&":
            return Value("bool", args[0].truth() & args[1].truth())
        if name == "||":
            return Value("bool", args[0].truth() | args[1].truth())
        if name == "!":
            return Value("bool", ~args[0].truth())
        if name in ("=", "!=", "<", ">", "<=", ">="):
            return Value("bool", compare(name, *args))
        if name in ("IN", "NOT IN"):
            any_of = reduce(lambda x, y: x | y, (compare("=", args[0], a) for a in args[1:]), F.lit(False))
            return Value("bool", any_of if name == "IN" else ~any_of)
        if name in ("+", "-", "*", "/"):
            a, b = args[0].number(), args[1].number()
            return Value("num", {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[name])
        if name == "BOUND":
            return Value("bool", args[0].col.isNotNull())
        if name == "IF":
            branches = args[1:] if args[1].kind == args[2].kind else [Value("term", a.term()) for a in args[1:]]
            test = args[0].truth()
            return Value(branches[0].kind, F.when(test, branches[0].col).when(~test, branches[1].col))
        if name == "COALESCE":
            if len({a.kind for a in args}) == 1:
                return Value(args[0].kind, F.coalesce(*(a.col for a in args)))
            return Value("term", F.coalesce(*(a.term() for a in args)))
        if name in ("STR", XSD + "string"):
            return Value("str", text[0])
        if name == "LCASE":
            return Value("str", F.lower(text[0]))
        if name == "UCASE":
            return Value("str", F.upper(text[0]))
        if name == "STRLEN":
            return Value("int", F.char_length(text[0]))
        if name == "CONCAT":
            return Value("str", F.concat(*text) if text else F.lit(""))
        if name == "CONTAINS":
            return Value("bool", F.contains(text[0], text[1]))
        if name == "STRSTARTS":
            return Value("bool", F.startswith(text[0], text[1]))
        if name == "STRENDS":
            return Value("bool", F.endswith(text[0], text[1]))
        if name == "STRAFTER":
            at = F.instr(text[0], text[1])
            return Value("str", F.when(at > 0, F.substring(text[0], at + F.char_length(text[1]), F.char_length(text[0]))).otherwise(F.when(text[0].isNotNull(), "")))
        if name == "STRBEFORE":
            at = F.instr(text[0], text[1])
            return Value("str", F.when(at > 0, F.substring(text[0], F.lit(1), at - 1)).otherwise(F.when(text[0].isNotNull(), "")))
        if name == "SUBSTR":
            n = args[2].number().cast("int") if len(args) > 2 else F.char_length(text[0])
            return Value("str", F.substring(text[0], args[1].number().cast("int"), n))
        if name == "REPLACE":
            return Value("str", F.regexp_replace(text[0], text[1], text[2]))
        if name == "REGEX":
            flags = text[2] if len(text) > 2 else F.lit("")
            return Value("bool", text[0].isNotNull() & F.regexp_like(text[0], F.when(flags.contains("i"), F.concat(F.lit("(?i)"), text[1])).otherwise(text[1])))
        if name in ("YEAR", "MONTH", "DAY"):
            part = {"YEAR": F.year, "MONTH": F.month, "DAY": F.day}[name]
            date = args[0].col if args[0].kind == "date" else F.substring(text[0], 1, 10).try_cast("date")
            return Value("int", part(date))
        if name in (XSD + "date", XSD + "dateTime"):
            return Value("date", F.substring(text[0], 1, 10).try_cast("date"))
        if name in (XSD + "integer", XSD + "int", XSD + "long"):
            return Value("int", text[0].try_cast("bigint"))
        if name in (XSD + "decimal", XSD + "double", XSD + "float"):
            return Value("num", text[0].try_cast("double"))
        if name == XSD + "boolean":
            return Value("bool", text[0].try_cast("boolean"))
        if name in ("ABS", "CEIL", "FLOOR", "ROUND"):
            return Value("num", {"ABS": F.abs, "CEIL": F.ceil, "FLOOR": F.floor, "ROUND": F.round}[name](args[0].number()).cast("double"))
        if name == "LANG":
            return Value("str", F.when(args[0].col["t"].startswith("@"), F.substring(args[0].col["t"], F.lit(2), F.char_length(args[0].col["t"]))).otherwise(F.when(args[0].col["k"] == "lit", "")))
        if name == "LANGMATCHES":
            return Value("bool", F.when(text[1] == "*", text[0] != "").otherwise((F.lower(text[0]) == F.lower(text[1])) | F.lower(text[0]).startswith(F.concat(F.lower(text[1]), F.lit("-")))))
        if name == "DATATYPE":
            t = args[0].term()
            return Value("term", T.term(F.when(t["t"] == "", F.lit(XSD + "string")).when(t["t"].startswith("@"), F.lit(T.RDF + "langString")).otherwise(t["t"]), "iri"))
        if name in ("ISIRI", "ISURI", "ISLITERAL", "ISBLANK"):
            kind = {"ISLITERAL": "lit", "ISBLANK": "bnode"}.get(name, "iri")
            return Value("bool", args[0].term()["k"] == kind)
        if name in ("IRI", "URI"):
            return Value("term", T.term(text[0], "iri"))
        raise P.QueryError("unknown_term", f"unknown function {name}")

    def aggregate(self, e: P.Call, frame: Frame, column: Callable) -> Value:
        if e.name == "COUNT" and not e.args:
            return Value("int", F.count_distinct(*(column(n) for n in frame.names)) if e.distinct else F.count("*"))
        arg = self.value(e.args[0], frame, column)
        if e.name == "COUNT":
            return Value("int", F.count_distinct(arg.term()) if e.distinct else F.count(arg.term()))
        if e.name in ("SUM", "AVG"):
            fold = F.sum_distinct if e.distinct and e.name == "SUM" else F.sum if e.name == "SUM" else F.avg
            return Value("num", F.coalesce(fold(arg.number()), F.lit(0.0)))
        if e.name in ("MIN", "MAX"):
            fold = F.min if e.name == "MIN" else F.max
            if arg.kind in ("num", "int"):
                return Value(arg.kind, fold(arg.col))
            t = arg.term()
            number = F.when(t["t"].isin(T.NUMERIC), F.expr("0D") + t["v"].try_cast("double"))
            return Value("term", fold(F.when(t.isNotNull(), F.struct(number.alias("n"), t["v"].alias("v"), t["k"].alias("k"), t["t"].alias("t")))).alias("__m"))
        if e.name == "SAMPLE":
            return Value("term", F.min(arg.term()))
        texts = F.collect_set(arg.text()) if e.distinct else F.collect_list(arg.text())
        return Value("str", F.array_join(F.array_sort(texts), e.separator))

    # --- queries ---
    def has_aggregate(self, e: Any) -> bool:
        return isinstance(e, P.Call) and (e.name in P.AGGREGATES or any(self.has_aggregate(a) for a in e.args))

    def compile(self, query: P.Query, bindings: dict[str, P.Term] | None = None, terms: bool = False) -> DataFrame:
        """The query's rows: one column per selected name, lexical values (or ``terms``, as written in Turtle)."""
        where = query.where
        if bindings:
            where = P.Group([*(P.Bind(t, P.Var(n)) for n, t in bindings.items()), *where.parts])
        frame, late = self.group(where)
        frame = self.filtered(frame, late)
        df = frame.df if frame.df is not None else self.spark.range(1).select()
        if query.form == "ask":
            return df.limit(1).agg((F.count("*") > 0).alias("answer"))
        items = query.items or [(P.Var(n), n) for n in frame.names if not n.startswith("__")]
        render = (lambda v: T.n3(v.term())) if terms else Value.plain
        if query.group_by or query.having or any(self.has_aggregate(e) for e, _ in items):
            keys = []
            for i, g in enumerate(query.group_by):
                e, n = g if isinstance(g, tuple) else (g, g.name if isinstance(g, P.Var) else f"__g{i}")
                if not isinstance(e, P.Var):
                    df = df.withColumn(n, self.value(e, frame, F.col).term())
                    frame = Frame(df, frame.sure, frame.maybe | {n})
                elif n not in frame.names:
                    df = df.withColumn(n, F.lit(None).cast("struct<v:string,k:string,t:string>"))
                    frame = Frame(df, frame.sure, frame.maybe | {n})
                keys.append(n)
            computed = {f"__a{i}": self.value(e, frame, F.col) for i, (e, _) in enumerate(items) if self.has_aggregate(e)}
            tests = {f"__h{i}": self.value(e, frame, F.col).truth() for i, e in enumerate(query.having)}
            orders = {f"__o{i}": self.value(e, frame, F.col) for i, (e, _) in enumerate(query.order_by) if self.has_aggregate(e)}
            folds = [v.col.alias(n) for n, v in {**computed, **orders}.items()] + [c.alias(n) for n, c in tests.items()]
            df = df.groupBy(*keys).agg(*folds) if folds else df.select(*keys).distinct()
            for n in tests:
                df = df.filter(n)
            frame = Frame(df, frame.sure & frozenset(keys), frozenset(keys) - frame.sure)
            values = [Value(computed[f"__a{i}"].kind, F.col(f"__a{i}")) if f"__a{i}" in computed else self.value(e, frame, F.col) for i, (e, _) in enumerate(items)]
        else:
            orders = {}
            values = [self.value(e, frame, F.col) for e, _ in items]
        columns = [render(v).alias(n) for v, (_, n) in zip(values, items)]
        named = {n: v for v, (_, n) in zip(values, items)}
        sort = []
        for i, (e, up) in enumerate(query.order_by):
            if f"__o{i}" in orders:
                key = Value(orders[f"__o{i}"].kind, F.col(f"__o{i}"))
            elif isinstance(e, P.Var) and e.name in named:
                key = named[e.name]
            elif self.mentioned(e) and not self.mentioned(e) & (set(frame.names) | set(named)):
                continue  # never bound: orders nothing
            else:
                key = self.value(e, frame, F.col)
            for c in [key.number(), key.text()] if key.kind == "term" else [key.col]:
                sort.append(c.asc_nulls_first() if up else c.desc_nulls_last())
        if query.distinct:
            names = [n for _, n in items]
            keyed = df.select(*columns, *(self._key(e, i, orders, named, frame) for i, (e, _) in enumerate(query.order_by) if self._sorts(e, frame, named)))
            extra = [c for c in keyed.columns if c.startswith("__k")]
            df = keyed.groupBy(*names).agg(*(F.min(c).alias(c) for c in extra)) if extra else keyed.distinct()
            ups = [up for e, up in query.order_by if self._sorts(e, frame, named)]
            if extra:
                df = df.orderBy(*(F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in zip(extra, ups)))
            df = df.select(*names)
        else:
            df = (df.orderBy(*sort) if sort else df).select(*columns)
        if query.offset:
            df = df.offset(query.offset)
        return df.limit(query.limit) if query.limit is not None else df

    def _sorts(self, e: Any, frame: Frame, named: dict) -> bool:
        return self.has_aggregate(e) or not self.mentioned(e) or bool(self.mentioned(e) & (set(frame.names) | set(named)))

    def _key(self, e: Any, i: int, orders: dict, named: dict, frame: Frame) -> Column:
        key = Value(orders[f"__o{i}"].kind, F.col(f"__o{i}")) if f"__o{i}" in orders else named[e.name] if isinstance(e, P.Var) and e.name in named else self.value(e, frame, F.col)
        return (F.struct(key.number(), key.text()) if key.kind == "term" else key.col).alias(f"__k{i}")


def run(triples: DataFrame, text: str, prefixes: dict[str, str] | None = None, counts: dict[str, int] | None = None, bindings: dict[str, P.Term] | None = None, terms: bool = False) -> DataFrame:
    """Parse and compile a query over a triples frame."""
    return Compiler(triples, counts).compile(P.parse(text, prefixes), bindings, terms)
