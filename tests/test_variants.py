import json
import math
import random
import re

from graphloom.functions import variants as V

WORDS = ["", " a  b ", "c\n\td", "7", " 1.5 ", "1_000", "nan", "inf", "1e3", "1d", ".5", "x.y", "５"]


def value(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.5:
        return rng.choice([*WORDS, 1, 2.5, -3, True, False, None, 10**12, 1e300])
    if kind < 0.75:
        return {rng.choice("abcdefg"): value(rng, depth - 1) for _ in range(rng.randrange(4))}
    return [value(rng, depth - 1) for _ in range(rng.randrange(4))]


def ordered(x):
    return {k: ordered(x[k]) for k in sorted(x)} if isinstance(x, dict) else [ordered(v) for v in x] if isinstance(x, list) else x


def strings(x):
    if isinstance(x, str):
        yield x
    for v in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
        yield from strings(v)


def numbers(x, path=""):
    if isinstance(x, dict):
        return {k: v for a, b in x.items() for k, v in numbers(b, f"{path}.{a}" if path else a).items()}
    if isinstance(x, list):
        return {k: v for i, b in enumerate(x) for k, v in numbers(b, f"{path}[{i}]").items()}
    try:
        n = float(x) if x is not None and (not isinstance(x, str) or x.isascii()) else math.nan
    except ValueError:
        return {}
    return {path: n} if path and math.isfinite(n) else {}


def test_equals_plain_walks(spark):
    rng = random.Random(8)
    rows = [(i, ordered(value(rng, 5))) for i in range(150)]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in rows] + [(900, "{bad"), (901, None)], "id int, j string").repartition(4)
    got = {}
    for r in V.flat_numbers(df, "id", "j").collect():
        got.setdefault(r.key, {})[r.path] = r.value
    assert got == {i: n for i, x in rows if (n := numbers(x))}
    found = {}
    for r in sorted(V.texts(df, "id", "j").collect(), key=lambda r: (r.key, r["at"])):
        found.setdefault(r.key, []).append(r.text)
    want = {i: list(dict.fromkeys(n for s in strings(x) if (n := re.sub(r"\s+", " ", s.strip())))) for i, x in rows}
    assert found == {i: w for i, w in want.items() if w}
    assert [tuple(r) for r in V.unparsed(df, "id", "j").collect()] == [(900, "{bad")]


def test_depth_has_no_bound(spark):
    deep = "7"
    for i in range(60):
        deep = f'{{"k": {deep}}}' if i % 2 else f"[{deep}]"
    got = V.flat_numbers(spark.createDataFrame([(1, deep)], "id int, j string"), "id", "j").collect()
    assert len(got) == 1 and got[0].value == 7.0 and got[0].path.count("k") == 30


def test_statements(spark):
    x = {
        "subject": "A", "predicate": "", "object": "B",
        "evidence": [
            {"type": "Fact", "value": " x | y | z "},
            {"type": "fact", "value": "x | y"},
            {"type": "text", "value": "- \"P\" → q -> 'R'\nno\n→ half → C\nA -> b -> "},
            {"triple": {"s": "S", "p": "t", "o": "O"}},
            {"head": "H", "tail": 5},
            {"s": "only"},
        ],
    }
    rows = V.statements(spark.createDataFrame([(1, json.dumps(x))], "id int, j string"), "id", "j").collect()
    got = [(r.s, r.p, r.o) for r in sorted(rows, key=lambda r: (r["at"], r.pos))]
    # of {"triple": {...}} the outer and the inner object both state it
    assert got == [("A", "", "B"), ("x", "y", "z"), ("P", "q", "R"), ("S", "t", "O"), ("S", "t", "O"), ("H", "", "5")]


def test_empty(spark):
    none = spark.createDataFrame([], "id int, j string")
    assert V.texts(none, "id", "j").collect() == V.flat_numbers(none, "id", "j").collect() == V.statements(none, "id", "j").collect() == []
