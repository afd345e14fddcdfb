import random

from graphloom.operators import context as X
from graphloom.operators.graph import label_propagation
from graphloom.terms import LABEL, SCHEMA, TRIPLE_SCHEMA

E = "src string, predicate string, dst string"


def graph(seed=1, n=60, m=140):
    rng = random.Random(seed)
    p = ["http://x/member", "http://x/location", "http://x/other", "http://x/inAlbum"]
    return sorted({(f"n{rng.randrange(n):02}", rng.choice(p), f"n{rng.randrange(n):02}") for _ in range(m)})


def scores(edges, section, taken):
    w = lambda p: X.WEIGHTS.get(p.rsplit("/", 1)[-1], 1.0)
    deg, out = {}, {}
    for a, _, b in edges:
        deg[a], deg[b] = deg.get(a, 0) + 1, deg.get(b, 0) + 1
    for a, p, b in edges:
        for x, y in ((a, b), (b, a)):
            if x in section and y not in section and y not in taken:
                out[y] = out.get(y, 0) + w(p)
    return sorted(((-round(s + 0.1 * deg[v], 9), v) for v, s in out.items()))


def test_frontiers_of_all_sections(spark):
    edges = graph()
    sections = {"a": {"n00", "n01", "n02"}, "b": {"n02", "n30"}, "c": {"nowhere"}}
    e, s = spark.createDataFrame(edges, E), spark.createDataFrame([(k, v) for k, x in sections.items() for v in x], "section string, node string")
    got = {(r.section, r["rank"]): (r.node, r.score) for r in X.frontiers(e, s, 5).collect()}
    want = {(k, i + 1): (v, -w) for k, x in sections.items() for i, (w, v) in enumerate(scores(edges, x, set())[:5])}
    assert got == want and len(want) == 10
    facts = X.extra_facts(e, s, X.frontiers(e, s, 2), 6).collect()
    assert {r.section for r in facts} == {"a", "b"} and max(r.place for r in facts) <= 6
    for k in "ab":
        near = [v for _, v in scores(edges, sections[k], set())[:2]]
        told = {}
        for f in edges:
            for i, v in enumerate(near):
                if v in (f[0], f[2]):
                    other = f[2] if f[0] == v else f[0]
                    told[f] = min(told.get(f, (9, 9)), (i, other not in sections[k]))
        assert [tuple(r)[2:] for r in sorted(facts, key=lambda r: r.place) if r.section == k] == sorted(told, key=lambda f: (*told[f], f))[:6]
    new = X.spawned(e, X.frontiers(e, s, 1)).collect()
    for k in "ab":
        top = scores(edges, sections[k], set())[0][1]
        ego = {top} | {b for a, _, b in edges if a == top} | {a for a, _, b in edges if b == top}
        assert {r.node for r in new if r.origin == top} == ego


def test_growth_equals_the_plain_loop(spark):
    edges = graph(2, 120, 260)
    sections = {"a": {"n000"[:3], "n01"}, "b": {"n50"}, "c": {"n51", "n01"}, "d": {"none"}}
    for budget, step in ((12, 3), (5, 5), (1000, 7)):
        have = {k: {v: 0 for v in x} for k, x in sections.items()}
        left, rounds = dict.fromkeys(sections, budget), 0
        while True:
            rounds += 1
            taken = set().union(*have.values())
            wished = {}
            for k in sections:
                for w, v in scores(edges, set(have[k]), taken)[: min(step, left[k])]:
                    wished.setdefault(v, []).append((w, k))
            if not wished:
                break
            for v, claims in wished.items():
                k = min(claims)[1]
                have[k][v] = rounds
                left[k] -= 1
        e, s = spark.createDataFrame(edges, E), spark.createDataFrame([(k, v) for k, x in sections.items() for v in x], "section string, node string")
        got = {(r.section, r.node): r["round"] for r in X.grow(e, s, budget, step).collect()}
        assert got == {(k, v): r for k, x in have.items() for v, r in x.items()}
        claimed = [v for (k, v), r in got.items() if r]
        assert len(claimed) == len(set(claimed))


def test_memberships_and_triples(spark):
    m = "http://x/"
    edges = [("http://x/Membership_1", m + "involvesMusicEnsemble", "http://x/band"), ("http://x/Membership_1", m + "involvesMemberOfMusicEnsemble", "http://x/Barry_M"), ("http://x/Membership_1", m + "startDate", "lit::1970")]
    edges += [("http://x/Membership_2", m + "involvesMusicEnsemble", "http://x/band"), ("http://x/Membership_2", m + "involvesMemberOfMusicEnsemble", "http://x/out"), ("http://x/band", m + "location", "http://x/London"), ("http://x/band", m + "location", "http://x/London")]
    labels = spark.createDataFrame([("http://x/band", "Queen"), ("lit::1970", "1970-07"), ("http://x/London", "http://label")], "node string, label string")
    nodes = ["http://x/Membership_1", "http://x/Membership_2", "http://x/band", "http://x/Barry_M", "lit::1970", "http://x/London"]
    s = spark.createDataFrame([("s", n) for n in nodes], "section string, node string")
    e = spark.createDataFrame(edges, E)
    assert [tuple(r) for r in X.memberships(e, labels, s).collect()] == [("s", "http://x/Membership_1", "Queen", "member (since 1970-07)", "Barry M")]
    got = sorted(X.section_triples(e, labels, s, 5).collect(), key=lambda r: r.place)
    assert [tuple(r)[2:] for r in got] == [("Queen", "member (since 1970-07)", "Barry M"), ("Queen", "location", "London")]
    assert X.section_triples(e, labels, s, 1).count() == 1


def test_seeds(spark):
    rows = [(f"http://x/{i}", p, o, "iri", "lit", "", "") for i, (p, o) in enumerate([(LABEL, "Queen"), (SCHEMA + "name", "QUEEN"), (LABEL, "Other"), *[(LABEL, "queen")] * 6])]
    t = spark.createDataFrame(rows, TRIPLE_SCHEMA)
    assert {r.node for r in X.seeds(t, ["a", "a"], ["Queen"]).collect()} == {"a"}
    assert {r.node for r in X.seeds(t, None, ["queen"]).collect()} == {f"http://x/{i}" for i in (0, 1, 3, 4, 5)}
    assert {r.node for r in X.seeds(t, None, None, lambda t: t.filter("o = 'Other'").select("s")).collect()} == {"http://x/2"}
    assert X.seeds(t).collect() == []


def test_outline_and_paths(spark):
    edges = [("a1", "p", "a2"), ("a2", "p", "a3"), ("a1", "p", "a3"), ("b1", "p", "b2"), ("c1", "p", "c2"), ("c2", "p", "c3"), ("c3", "p", "c1"), ("c1", "q", "c4"), ("c3", "q", "c4")]
    e = spark.createDataFrame(edges, E)
    labels = spark.createDataFrame([("c1", "First"), ("a1", "http://no")], "node string, label string")
    members, beats = X.outline_by_communities(e, label_propagation(e), labels, 2)
    assert {r.node for r in members.collect() if r.section == "seg_001"} == {"c1", "c2", "c3", "c4"}
    assert {(r.section, r.beat) for r in beats.collect()} == {("seg_001", "First / c3 / c2"), ("seg_002", "a1 / a2 / a3")}
    line = spark.createDataFrame([(f"v{i}", "p", f"v{i + 1}") for i in range(5)] + [("v0", "p", "w1"), ("w1", "p", "v2")], E)
    got = X.paths(line, spark.createDataFrame([("zz", 0), ("v0", 1), ("v3", 2)], "node string, place int"), spark.createDataFrame([("v4",), ("v2",), ("zz",), ("v0",)], "node string"))
    assert sorted((r.target, r.pos, r.node) for r in got.collect()) == sorted([("v4", i, f"v{i}") for i in range(5)] + [("v2", 0, "v0"), ("v2", 1, "v1"), ("v2", 2, "v2"), ("zz", 0, "zz"), ("v0", 0, "v0")])


def test_lines(spark):
    rows = [
        ("s", 0, "text", "Graph neighborhood: - A → p → B - → half → C - C → q → lit::x9 D"),
        ("s", 1, "triple", "a → P → b"),
        ("s", 2, "triple", "broken"),
        ("s", 3, "fact", "short"),
        ("s", 4, None, "too short"),
        ("s", 5, "text", "“long enough”  text"),
        ("s", 6, "fact", "w " * 100),
        ("s", 7, "fact", None),
        ("t", 0, "fact", "short"),
    ]
    got = X.exploded(spark.createDataFrame(rows, "section string, pos int, type string, value string")).collect()
    want = ["A → p → B", "C → q → D", "short", '"long enough" text', ("w " * 90).strip() + "…"]
    assert [r.line for r in sorted(got, key=lambda r: r.pos) if r.section == "s"] == want
    assert [(r.pos, r.line) for r in got if r.section == "t"] == [(1, "short")]


def test_empty(spark):
    e, s = spark.createDataFrame([], E), spark.createDataFrame([], "section string, node string")
    labels = spark.createDataFrame([], "node string, label string")
    assert X.frontiers(e, s, 3).collect() == X.grow(e, s, 3).collect() == X.section_triples(e, labels, s, 3).collect() == []
