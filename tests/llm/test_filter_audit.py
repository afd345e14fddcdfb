import random
import re
from itertools import permutations

from graphloom.llm import filter_audit as F11

DOCS = "doc_id long, text string, lang string, part string, `a.b` int"
LABELS = "doc_id long, quality int, toxic int, part string"


def brute(docs, labels):
    """Every order run over every document, one filter after the other."""
    good = {i for i, q, *_ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t, *_ in labels if t == 1 and i is not None}
    first = {}
    for i, t, *_ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    parts = {}
    for i, t, lang, *_ in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and t in first and first[t] < i,
        }
        parts.setdefault(lang or "", []).append((fails, i in good, i in toxic))
    rows, removed_by = {}, {}
    for part, all_docs in parts.items():
        for order in permutations("ABCDE"):
            left = list(all_docs)
            for k, x in enumerate(order):
                gone = [d for d in left if d[0][x]]
                left = [d for d in left if not d[0][x]]
                redundant = sum(d[0][x] and any(d[0][y] for y in order[:k]) for d in all_docs)
                unique = sum(d[0][x] and sum(d[0].values()) == 1 for d in all_docs)
                rows[part, "".join(order), k + 1] = [len(left), len(gone), redundant, unique, sum(d[1] for d in gone), sum(d[2] for d in gone)]
                removed_by[part, x] = removed_by.get((part, x), 0) + len(gone)
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


def corpus():
    rng = random.Random(11)
    say = lambda n, words: " ".join(rng.choice(words) for _ in range(n))
    many = [f"w{i}" for i in range(900)]
    texts = [None, "", " \t\n", say(250, many), say(250, ["a", "b"]), say(199, many), say(200, many), say(250, many) + " #", say(250, ["ABCD", *many[:300]]), "é" * 97 + "ABC", "x" * 60000]
    docs = [(i, rng.choice(texts) if rng.random() < 0.6 else say(rng.randrange(150, 260), many[: rng.randrange(60, 900)]) + rng.choice(["", " $", " Z"]), rng.choice(["en", "de", "", None]), "p", 1) for i in range(150)]
    docs += docs[:30]  # repeated rows
    docs += [(None, texts[3], "en", "p", 1), (None, texts[3], "en", "p", 1), (None, "only here", None, "p", 1), (7, "another text of the same id", "fr", "p", 1)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "x") for i in range(0, 160, 2)] + [(4, 1, 1, "x"), (4, 0, 0, "x"), (None, 1, 1, "x")]
    return docs, labels


def result(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_equals_running_every_order(spark):
    docs, labels = corpus()
    df = F11.audit(spark.createDataFrame(docs, DOCS).repartition(7), spark.createDataFrame(labels, LABELS))
    want = brute(docs, labels)
    got = df.collect()
    assert len(got) == len(want) == 600 * 4
    assert result(df) == want


def test_equal_ids_of_unequal_parts(spark):
    docs = [(1, "same", "en", "", 0), (1, "same", "de", "", 0), (2, "same", "de", "", 0), (2, "same", "de", "", 0), (0, "other", "de", "", 0)]
    assert result(F11.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], LABELS))) == brute(docs, [])


def test_survivors_over_all_parts(spark):
    docs, labels = corpus()
    rows = F11.failures(spark.createDataFrame(docs, DOCS))
    alive = {(r.part, r["mask"]): r.docs for r in F11.survivors(F11.profile(rows, spark.createDataFrame(labels, LABELS))).collect()}
    assert alive[None, 0] == len(docs) == sum(n for (part, mask), n in alive.items() if part is not None and mask == 0)
    order = {("".join(o), k): sum(map(F11.bit, o[:k])) for o in permutations("ABCDE") for k in range(1, 6)}
    want = brute(docs, labels)
    for (part, name, k), row in want.items():
        assert alive.get((part, order[name, k]), 0) == row[0]


def test_empty_tables(spark):
    docs, labels = corpus()
    assert F11.audit(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, LABELS)).collect() == []
    got = result(F11.audit(spark.createDataFrame([(1, None, None, "", 0)], DOCS), spark.createDataFrame([], LABELS)))
    assert got == brute([(1, None, None)], [])
