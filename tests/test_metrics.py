"""Metrics of texts and kinds of evidence against plain Python."""

import math
import re

import pytest

from graphloom.operators import evaluate, graph
from graphloom.operators import metrics as M

TEXTS = [
    "In 1985 Anna Maria Berg met 3 people. Later, in 1979, Berg saw 4 people, and the BBC came. The Berg of Anna said 4 people were very kind.",
    "One two. One two. One two. Other words here?",
    "Earlier events in 1990. He came later in 1980. Earlier still, 1995 it was!",
    "", "word", "  ", "Dogs were barked at. Cats; birds, which sing but that is all.",
]


def split(t):
    return [x.strip() for x in re.split(r"(?<=[.!?])\s+", t.strip()) if x.strip()]


def words(t):
    return re.findall("[a-z0-9']+", t.lower())


def lemma(w):
    w = re.sub("'s$", "", w.lower())
    for end, n in (("ing", 5), ("ed", 4), ("es", 4), ("s", 3)):
        if w.endswith(end) and len(w) > n:
            return w[: -len(end)]
    return w


def jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def named(s):
    return re.findall(M.NAME.replace("(?U)", ""), s) + re.findall(r"\b[A-Z]{2,}\b", s)


def root(e):
    return re.sub("[^A-Za-z0-9]", "", e.split()[-1]).lower()


def content(w):
    return re.fullmatch("[a-z]+", w) and w not in M.FUNCTION_WORDS


def quarter(x):
    return sorted(x)[max(0, int(len(x) * 0.25) - 1)] if x else 0.0


def avg(x):
    return sum(x) / len(x) if x else 0.0


def test_metrics_of_texts(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    got = {r.i: r for r in M.consistency(M.overlap(M.redundancy(df, "text", 0.9, "A"), "text", "A"), "text", "A").collect()}
    for i, t in enumerate(TEXTS):
        s, w, r = split(t), words(t), got[i]
        grams = [{x.lower()[k : k + 3] for k in range(len(x) - 2)} for x in s]
        lengths = [len(words(x)) for x in s]
        pairs = list(zip(range(len(s)), range(1, len(s))))
        assert r.novel_sentence_ratio == pytest.approx(len({x.lower() for x in s}) / len(s) if s else 0)
        assert r.near_dup_rate == pytest.approx(avg([float(jaccard(grams[a], grams[b]) >= 0.9) for a, b in pairs]))
        assert r.sent_len_avg == pytest.approx(avg(lengths)) and r.sent_len_p95 == (sorted(lengths)[max(0, math.ceil(0.95 * len(lengths)) - 1)] if lengths else 0)
        assert r.lexical_density == pytest.approx(sum(bool(content(x)) for x in w) / len(w) if w else 0)
        assert r.avg_clauses == pytest.approx(avg([1 + x.count(",") + x.count(";") + len(re.findall(r"\b(?:and|but|or|which|that)\b", x.lower())) for x in s]))
        ents, cont = [[root(e) for e in named(x)] for x in s], [[lemma(y) for y in words(x) if content(y)] for x in s]
        for name, sets in (("ent", ents), ("content", cont)):
            j = [jaccard(sets[a], sets[b]) for a, b in pairs]
            assert r[f"{name}_overlap_mean"] == pytest.approx(avg(j)) and r[f"{name}_overlap_p25"] == pytest.approx(quarter(j))
        forms = {e for x in s for e in named(x)}
        assert r.alias_switches == pytest.approx(1000 * (len(forms) - len({root(e) for e in forms})) / max(1, len(w)))
        conflicts = 0
        for k in range(len(s)):
            seen = {}
            for x in s[max(0, k - 2) : k + 3]:
                for n, noun in re.findall(r"\b(\d{1,3}(?:,\d{3})*|\d+(?:\.\d+)?)\s+([A-Za-z][a-z\-]+)\b", x):
                    seen.setdefault(lemma(noun), set()).add(float(n.replace(",", "")))
            conflicts += sum(len(v) > 1 for v in seen.values())
        assert r.number_conflicts == conflicts
        years = [[int(y) for y in re.findall(r"\b(1[89]\d{2}|20\d{2})\b", x)] for x in s]
        low, bad, last = [x.lower() for x in s], 0, None
        for a, b in pairs:
            if years[a] and years[b]:
                bad += ("later" in low[b] and max(years[b]) < min(years[a])) + ("earlier" in low[b] and min(years[b]) > max(years[a]))
            bad += any(x in low[b] for x in M.ONWARD) and any(x in low[a] for x in M.BACK)
        for x, y in zip(low, years):
            if y:
                if last is not None:
                    bad += ("later" in x and min(y) < last) + ("earlier" in x and min(y) > last)
                last = min(y)
        assert r.temporal_violations == bad


def test_parenthetical_and_patches(spark):
    rows = [
        (1, 1, "She sang.", "Anna Berg sang in Old Town in 1985 for 90 people"), (1, 2, "Nobody knew", "of 12 or so"), (1, 3, "He left.", "the red river"),
        (2, 1, "Anna Berg sang in town.", "Anna Berg sang in 1985"), (2, 2, "Quiet.", None),
    ]
    got = {(r.g, r.pos): r.fixed for r in M.patched(spark.createDataFrame(rows, "g int, pos int, text string, evidence string"), "g").collect()}
    assert got == {(1, 1): "She sang (Anna Berg, 1985).", (1, 2): "Nobody knew (12).", (1, 3): "He left.", (2, 1): rows[3][2], (2, 2): "Quiet."}


def test_gates(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0.3, 0.0, 0, 0, 0), (0.0, 0.25, 0, 0, 0), (0.1, 0.1, 0, 0, 1), (0.1, 0.1, 0, 0, 0)], "t double, c double, n int, m int, y int")
    rows = df.select(M.candidate_gate(*(F.col(c) for c in "tcnmy")).alias("a"), M.lexical_support(F.col("t") + 0.4, F.col("n"), F.col("m"), F.col("y")).alias("b")).collect()
    assert [tuple(r) for r in rows] == [(True, True), (True, False), (True, True), (False, False)]


def test_best_match_far_down_a_group(spark):
    """Places beyond 2**24 keep their order."""
    far = 1 << 30
    q = spark.createDataFrame([(1, 0, "the red stone bridge of 1985")], "g int, pos long, text string")
    c = spark.createDataFrame([(1, far + 5, "the red stone bridge of 1985"), (1, far + 2, "the red stone bridge of 1985"), (1, far, "other words")], "g int, pos long, text string")
    r = evaluate.best_match(q, c, "g").first()
    assert r.best_pos == far + 2 and r.c_text.startswith("the red")


def test_betweenness_beyond_one_task(spark):
    import random

    rng = random.Random(4)
    rows = [(f"n{rng.randrange(14)}", "p", f"n{rng.randrange(14)}") for _ in range(26)]
    e = spark.createDataFrame(rows, "src string, predicate string, dst string")
    one = {r.node: round(r.betweenness, 9) for r in graph.betweenness(e).collect()}
    assert one == {r.node: round(r.betweenness, 9) for r in graph.betweenness(e, max_nodes=0).collect()}
