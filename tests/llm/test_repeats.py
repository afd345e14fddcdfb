import hashlib
import random

import numpy as np
import pytest

from graphloom.llm import repeats as R
from graphloom.llm import substring_dedup as W
from graphloom.llm import suffix_dedup as B
from graphloom.llm.suffix_array import suffix_array

LAST = 1 << 62


def brute_words(rows, window=50):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, LAST), LAST if i is None else i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (LAST if i is None else i):
                gone.update(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(map(str, out))


def brute_bytes(rows, window=100):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - window + 1):
            key, at = b[k : k + window], (LAST if i is None else i, k)
            first[key] = min(first.get(key, at), at)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - window + 1):
            if first[b[k : k + window]] < (LAST if i is None else i, k):
                gone[k : k + window] = True
        gone = gone[:-1]
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = [c * k for c in "abcdeé" for k in (1, 2, 3)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passages = [say(rng.choice([20, 49, 50, 51, 80, 200])) for _ in range(6)]
    rows = []
    for i in range(n):
        t = say(rng.choice([0, 5, 60, 150]))
        for _ in range(rng.choice([0, 1, 1, 2])):
            t += rng.choice([" ", "\n", "  "]) + rng.choice(passages) + " " + say(rng.choice([0, 3, 40]))
        if rows and rng.random() < 0.3:
            words = rng.choice(rows)[1].split(" ")
            for _ in range(rng.choice([0, 1, 3])):
                words[rng.randrange(len(words))] = "edit"
            t = " ".join(words)
        rows.append((i, t))
    rng.shuffle(rows)
    return rows + [(200, None), (201, ""), (202, "x " * 400), (203, "x " * 300), (204, "q" * 350), (None, passages[-1] * 3), (None, passages[-1] * 3), (7, rows[0][1]), (7, rows[0][1])]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("block", [R.BLOCK, 400])
def test_match_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(R, "BLOCK", block)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, id int, blob int").repartition(5)
    if block == R.BLOCK:
        assert sorted(str(tuple(r)) for r in W.dedup_substrings(docs).collect()) == brute_words(rows)
    assert sorted(str(tuple(r)) for r in B.dedup_bytes(docs).collect()) == brute_bytes(rows)


@pytest.mark.parametrize("bucket,block", [(R.BUCKET_EXTENTS, 0), (30, R.BLOCK)])
def test_hot_seeds_against_brute_force(spark, monkeypatch, bucket, block):
    """One seed in 400 surroundings, of which some agree on one side: by window hashes, and with buckets that are never held."""
    monkeypatch.setattr(R, "BUCKET_EXTENTS", bucket)
    monkeypatch.setattr(R, "BLOCK", block)
    rng = random.Random(6)
    say = lambda tag, n: " ".join(f"{tag}{rng.randrange(10**6)}" for _ in range(n))
    seed, lefts, rights = say("s", 30), [say("l", 40) for _ in range(5)], [say("r", 40) for _ in range(5)]
    rows = [(i, " ".join((rng.choice(lefts) if rng.random() < 0.2 else say("x", 25), seed, rng.choice(rights) if rng.random() < 0.2 else say("y", 25)))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert sorted(str(tuple(r)) for r in W.dedup_substrings(docs).collect()) == brute_words(rows)
    assert sorted(str(tuple(r)) for r in B.dedup_bytes(docs).collect()) == brute_bytes(rows)


def test_a_bucket_is_held_in_parts(spark):
    """The largest number of extents that ``collapse`` gets at once in a bucket with one seed in 100,000 surroundings."""
    rng, s = np.random.default_rng(1), W.spec()
    n = 100_000
    x = {f: rng.integers(1, 60_000, n).astype(t) for f, t in R.FIELDS}
    x["anchor"][:] = 7
    x["id"][:] = x["extent"][:] = np.arange(n)
    blobs = [R.pack_extents({f: c[lo : lo + 1000] for f, c in x.items()}) for lo in range(0, n, 1000)]
    rows = spark.createDataFrame([(1, 7, None, None, bytearray(b)) for b in blobs], R.ROWS_SCHEMA)
    old, R.BUCKET_EXTENTS = R.BUCKET_EXTENTS, 5_000
    try:
        got = R.resolve(rows, s, 16, True).collect()
    finally:
        R.BUCKET_EXTENTS = old
    asked = [r for r in got if r.kind == 1]
    assert {r.block for r in asked} == {-1} and sum(len(r.blob) // 8 for r in asked) == n


def test_winnow_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    want = [max(range(i, i + 31), key=lambda p: (-int(hashes[p] >> np.uint64(28)), p)) for i in range(len(hashes) - 30)]
    assert R.winnow(hashes, 31).tolist() == want
    monkeypatch.setattr(R, "PLACE_BITS", 6)
    want = [max(range(i, i + 31), key=lambda p: (-int(hashes[p] >> np.uint64(6)), p)) for i in range(len(hashes) - 30)]
    assert R.winnow(hashes, 31).tolist() == want


def test_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr("graphloom.llm.common.BROADCAST_BYTES", 0)
    rows = corpus(3, 30)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(tuple(r)) for r in B.dedup_bytes(docs).collect()) == brute_bytes(rows)


def test_drop_repeats(spark):
    p = "ä wörd " * 3 + "the one long passage that will be repeated over and over, é, until somebody notices that it was said before"
    docs = spark.createDataFrame([(1, p, "en", 0), (2, "Before. " + p + " After.", "en", 0), (3, p, "de", 0), (4, None, None, None)], "doc_id long, text string, lang string, n_chars long")
    got = {r.doc_id: r for r in B.drop_repeats(docs).collect()}
    assert set(got) == {1, 2, 4} and got[1].text == p
    assert got[2].text == "Before.  After." and got[2].n_chars == 15 and got[2].lang == "en"
    assert B.drop_repeats(docs.limit(0)).count() == 0 and W.dedup_substrings(docs.limit(0)).count() == 0


def test_suffix_array():
    for seed in range(400):
        rng = random.Random(seed)
        text = bytes(rng.choice(b"abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 40)))
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
