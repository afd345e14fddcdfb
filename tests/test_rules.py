import random
import re

import pytest

from graphloom.operators import collections as C
from graphloom.operators import rules
from graphloom.terms import EX, OWL, RDF, RDFS, SCHEMA, SUBCLASS, SUBPROPERTY, TRIPLE_SCHEMA, TYPE, XSD


def triples(spark, rows):
    """(s, p, o[, datatype]): ``_:`` marks blank nodes, a datatype a literal ("" a plain one)."""
    kind = lambda x: "bnode" if x.startswith("_:") else "iri"
    full = [(s.removeprefix("_:"), p, o.removeprefix("_:") if not d else o, kind(s), "lit" if d else kind(o), d[0] if d else "", "") for s, p, o, *d in rows]
    return spark.createDataFrame(full, TRIPLE_SCHEMA).repartition(4)


def listed(name, items, end=RDF + "nil"):
    rows = []
    for i, x in enumerate(items):
        rows += [(f"_:{name}{i}", RDF + "first", x), (f"_:{name}{i}", RDF + "rest", f"_:{name}{i + 1}" if i + 1 < len(items) else end)]
    return rows


def found(spark, rows, heads):
    got = C.members(triples(spark, rows), spark.createDataFrame([(h,) for h in heads], "head string")).collect()
    return sorted((r.head, r.pos, r["item"]) for r in got if r.pos is not None), sorted((r.head, r["item"]) for r in got if r.pos is None)


def test_a_list_of_10000_in_few_rounds(spark):
    t = triples(spark, listed("n", [f"{EX}x{i}" for i in range(10_000)]))
    at, cyclic, rounds = C.ranked(t)
    assert rounds < 20 and cyclic.count() == 0
    got = C.members(t, spark.createDataFrame([("n0",), ("n9990",)], "head string")).collect()
    assert sorted((r.head, r.pos, r["item"]) for r in got) == sorted([("n0", i, f"{EX}x{i}") for i in range(10_000)] + [("n9990", i - 9990, f"{EX}x{i}") for i in range(9990, 10_000)])


def test_lists_that_share_run_in_circles_or_are_broken(spark):
    rows = listed("a", ["A0", "A1", "A2"]) + listed("b", ["B0", "B1"], end="_:a1") + listed("c", ["C0", "C1", "C2"], end="_:c0")
    rows += listed("s", ["S0", "S1"], end="_:r0") + listed("r", ["R0", "R1", "R2"], end="_:r0") + listed("a", ["A0"])[:1]
    rows += [("_:o0", RDF + "first", "O0"), ("_:o0", RDF + "first", "O1"), ("_:e0", RDF + "rest", RDF + "nil")]
    straight, circles = found(spark, rows, ["a0", "a1", "b0", "c1", "s0", "r1", "o0", "e0", "none", RDF + "nil"])
    assert straight == sorted(
        [("a0", 0, "A0"), ("a0", 1, "A1"), ("a0", 2, "A2"), ("a1", 0, "A1"), ("a1", 1, "A2"), ("b0", 0, "B0"), ("b0", 1, "B1"), ("b0", 2, "A1"), ("b0", 3, "A2")]
        + [("s0", 0, "S0"), ("s0", 1, "S1"), ("s0", 2, "R0"), ("s0", 3, "R1"), ("s0", 4, "R2"), ("o0", 0, "O0"), ("o0", 0, "O1")]
    )
    assert circles == sorted([("c1", x) for x in ("C0", "C1", "C2")] + [("r1", x) for x in ("R0", "R1", "R2")])
    issues = sorted(map(tuple, C.list_issues(triples(spark, rows)).select("code", "node").collect()))
    assert issues == sorted([("LIST_CYCLE", n) for n in ("c0", "c1", "c2", "r0", "r1", "r2")] + [("LIST_SHARED", "a1"), ("LIST_SHARED", "r0"), ("LIST_OPEN", "o0"), ("LIST_ITEM", "o0"), ("LIST_ITEM", "e0")])


def test_no_lists(spark):
    t = triples(spark, [(EX + "a", TYPE, EX + "B")])
    assert C.list_issues(t).collect() == [] == C.members(t, spark.createDataFrame([], "head string")).collect()


def plain(schema, data):
    """The rules said over sets and loops."""
    def after(p, s):
        return {o for a, b, o, *_ in schema if a == s and b == p}

    def star(p, x):
        seen, todo = {x}, [x]
        while todo:
            for y in after(p, todo.pop()) - seen:
                seen.add(y)
                todo.append(y)
        return seen

    def wants(p, predicates):
        out = set()
        for sp in star(SUBPROPERTY, p):
            for d in set().union(*(after(q, sp) for q in predicates)):
                out.add(d)
                for head in after(OWL + "unionOf", d):
                    for cell in star(RDF + "rest", head):
                        out |= after(RDF + "first", cell)
        return {x.removeprefix("_:") for x in out}

    def fits(c, d):
        equal = {c} | after(OWL + "equivalentClass", c) | {a for a, b, o, *_ in schema if b == OWL + "equivalentClass" and o == c}
        return any(d in star(SUBCLASS, e) for e in equal)

    types = {}
    for s, p, o, *lit in data:
        if p == TYPE and not lit and not o.startswith("_:"):
            types.setdefault(s, set()).add(o)
    rows = set()
    for s, p, o, *lit in set(data):
        if p in rules.ABOUT:
            continue
        name = s.removeprefix("_:")
        d, r = wants(p, rules.DOMAIN), wants(p, rules.RANGE)
        join = lambda x: "|".join(sorted(x))
        if not d:
            rows.add(("info", "domain_unknown", p, name, o.removeprefix("_:"), "", "", "", ""))
        elif s not in types:
            rows.add(("warn", "subject_untyped", p, name, o.removeprefix("_:"), "", "", "", join(d)))
        elif not any(fits(c, x) for c in types[s] for x in d):
            rows.add(("error", "domain_mismatch", p, name, o.removeprefix("_:"), join(types[s]), "", "", join(d)))
        if not r:
            rows.add(("info", "range_unknown", p, name, o.removeprefix("_:"), "", "", "", ""))
        elif lit:
            dt = lit[0] or XSD + "string"
            url = dt == XSD + "anyURI" or re.match(r"[A-Za-z][A-Za-z0-9+.-]*://[^/?#]", o)
            if not (RDFS + "Literal" in r or (dt in r and dt.startswith(XSD)) or (SCHEMA + "Text" in r and dt == XSD + "string") or (SCHEMA + "URL" in r and url)):
                rows.add(("error", "range_mismatch_literal", p, name, o, "", "", dt, join(r)))
        elif o.startswith("_:"):
            rows.add(("warn", "blank_node_object", p, name, o[2:], "", "", "", join(r)))
        elif o not in types:
            rows.add(("warn", "object_untyped", p, name, o, "", "", "", join(r)))
        elif not any(fits(c, x) for c in types[o] for x in r):
            rows.add(("error", "range_mismatch_iri", p, name, o, "", join(types[o]), "", join(r)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_sets_and_loops(spark, seed):
    rng = random.Random(seed)
    classes, props, nodes = ([f"{EX}{k}{i}" for i in range(n)] for k, n in (("C", 7), ("p", 8), ("n", 12)))
    ranges = [RDFS + "Literal", XSD + "integer", XSD + "string", SCHEMA + "Text", SCHEMA + "URL"]
    schema = [(rng.choice(classes), SUBCLASS, rng.choice(classes)) for _ in range(6)] + [(rng.choice(props), SUBPROPERTY, rng.choice(props)) for _ in range(4)]
    schema += [(rng.choice(classes), OWL + "equivalentClass", rng.choice(classes)) for _ in range(2)]
    for i, p in enumerate(props[:-1]):
        for predicates, values in ((rules.DOMAIN, classes), (rules.RANGE, classes + ranges)):
            if rng.random() < 0.4:
                schema.append((p, rng.choice(predicates), rng.choice(values)))
            if rng.random() < 0.3:
                name = f"u{i}{len(schema)}"
                end = rng.choice([RDF + "nil", RDF + "nil", f"_:{name}l0"])  # some run in a circle
                schema += [(p, rng.choice(predicates), f"_:{name}"), (f"_:{name}", OWL + "unionOf", f"_:{name}l0"), *listed(f"{name}l", rng.sample(values, 3), end)]
    data = [(n, TYPE, rng.choice(classes)) for n in nodes[:8] for _ in range(rng.choice([1, 2]))] + [("_:b", TYPE, classes[0])]
    literals = [("5", XSD + "integer"), ("word", ""), ("http://a.example/x", ""), ("http:nohost", ""), ("x", XSD + "anyURI"), ("y", XSD + "string")]
    for _ in range(150):
        s, p = rng.choice([*nodes, "_:b"]), rng.choice(props)
        data.append((s, p, *rng.choice(literals)) if rng.random() < 0.4 else (s, p, rng.choice([*nodes, "_:b"])))
    got = rules.check(triples(spark, data), triples(spark, schema))
    rows = [tuple(r[c] for c in rules.COLUMNS) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == plain(schema, data)


def test_checklists_are_written(spark, tmp_path):
    data = [(EX + "a", EX + "p", EX + "b"), (EX + "a", EX + "q", "x", "")]
    schema = [(EX + "p", RDFS + "domain", EX + "C"), (EX + "p", RDFS + "range", EX + "C")]
    issues = rules.check(triples(spark, data), triples(spark, schema)).cache()
    rules.write_checklists(issues, f"file://{tmp_path}/out")
    overview = spark.read.option("header", True).csv(f"file://{tmp_path}/out_overview")
    assert sorted(map(tuple, overview.collect())) == [(EX + "p", "object_untyped", "1"), (EX + "p", "subject_untyped", "1"), (EX + "q", "domain_unknown", "1"), (EX + "q", "range_unknown", "1")]
    assert len(rules.checklists(issues)) == 6 and spark.read.option("header", True).csv(f"file://{tmp_path}/out_untyped_nodes").count() == 2
    issues.unpersist()
