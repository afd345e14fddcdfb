import hashlib
import random
from collections import Counter

import pytest

from graphloom.llm import alignment as A13

TEXTS = [
    "Plain words, with a comma; and don't you're 'quoted' it's.",
    "two  spaces\n\nand\tlines \r\n of   odd white space ",
    " leading and trailing ",
    "\nfirst line\nsecond line\n",
    "",
    None,
    "café naïve über 中文字 \U0001f600\U0001f468‍\U0001f469 नमस्ते あ",
    "piece mark ▁ inside",
    "<|endoftext|> <s> </s> <unk> <0x0A>",
    "\x00\x01\x1c control\x85 x y",
    "x" * 3000,
    "word " * 2000,
    "12345 6,789.00 http://a.example/b?c=d#e CamelCaseWord snake_case_word",
    "é ﬁ Ω ½",
    " ",
    "\n",
    "a",
]


def brute(texts, links="ends"):
    """Whole texts, plain loops over all pairs of tokens."""
    t = A13.Aligner()
    out, count = [], Counter()
    for text in texts:
        if not text:
            out.append(None)
            continue
        a, b = t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)
        if b"".join(t.bytes_a[i] for i in a) != (" " + text).encode() or b"".join(t.bytes_b[i] for i in b) != (" " + text).encode():
            out.append(None)
            continue
        spans = []
        for ids, table in ((a, t.bytes_a), (b, t.bytes_b)):
            at, mine = 0, []
            for i in ids:
                mine.append((at, at + len(table[i]), i))
                at += len(table[i])
            spans.append(mine)
        both = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, lo = [], 0
        for hi in both:
            groups.append(tuple([i for s, e, i in side if lo <= s and e <= hi] for side in spans))
            lo = hi
        if links == "ends":
            pairs = [(x[2], {e: i for _, e, i in spans[1]}[x[1]]) for x in spans[0] if x[1] in {e for _, e, _ in spans[1]}]
        elif links == "overlap":
            pairs = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        else:
            pairs = [(x, y) for g in groups for x in g[0] for y in g[1]]
        count.update(pairs)
        out.append((len(a), len(b), groups, pairs))
    top = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    told = []
    for o in out:
        if o is None:
            told.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, pairs = o
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        told.append((n_a, n_b, len(groups), len(pairs), sum(count[p] == top[p[1]] for p in pairs), sum(count[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest()))
    return told


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def noise(rng):
    kinds = ["abc", "de", " ", " ", "\n", "  ", "\t", "'s", ".", "7", "é", "中", "▁", " ", "\x1f", "Z", "the", "ing", "\U0001f600", "\r\n", "_"]
    return "".join(rng.choice(kinds) for _ in range(rng.randrange(1, 40)))


@pytest.mark.parametrize("links", A13.LINKS)
def test_equals_plain_loops(spark, links):
    rng = random.Random(4)
    texts = [t for t in TEXTS if links == "ends" or len(t or "") < 4000] + [noise(rng) for _ in range(300)]
    texts += texts[:20]  # repeated rows
    rows = [(i if i != 3 else None, t, "x", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, batch string, pair int").repartition(5)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in A13.align(df, links=links).collect()}
    want = dict(zip([r[0] for r in rows], brute(texts, links), strict=True))
    assert {k: (got.get(k), v) for k, v in want.items() if got.get(k) != v} == {}
    assert len(got) == len(rows)


def test_forgetting_changes_nothing():
    rng = random.Random(5)
    texts = [noise(rng) for _ in range(200)]
    few, many = A13.Aligner(known=3), A13.Aligner()
    for lo in range(0, 200, 20):
        for x, y in zip(few(texts[lo : lo + 20]), many(texts[lo : lo + 20]), strict=True):
            assert list(map(str, x)) == list(map(str, y))


def test_cuts_join_to_the_text():
    rng = random.Random(6)
    one = A13.Aligner()
    for t in [noise(rng) for _ in range(500)] + [t for t in TEXTS if t]:
        assert "".join(one.cuts(t)) == " " + t
        assert one.cuts(t) == A13.CUT.split(" " + t)


def test_no_rows(spark):
    assert A13.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = A13.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
