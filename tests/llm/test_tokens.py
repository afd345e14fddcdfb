import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphloom.llm import packing as P
from graphloom.llm import token_files as F
from graphloom.llm.tokens import Encoder, encoder

PLAIN = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
PIECES = ["The", " ", "\n", "\t", "́", "e", "Σ", "ΑΣ", "it's", "don't", "<|endoftext|>", "\x1c", " ", "　", "\x0b", "\x85", "12", "!!", "ñ", "漢字", "\x00", "İ", "🙂"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join) | st.text(max_size=60))
def test_same_as_whole_text(text):
    text = text.encode("utf-8", "ignore").decode()
    ids, sizes = encoder()([text.encode()])
    assert ids.tolist() == PLAIN.encode(text, add_special_tokens=False).ids and sizes.tolist() == [len(ids)]


def test_forgetting():
    e = Encoder(known=3)
    for t in ("a b c d", "e f", "a b", ""):
        assert e([t.encode()])[0].tolist() == PLAIN.encode(t, add_special_tokens=False).ids


def rows():
    rng = random.Random(6)
    out = [(i, " ".join(rng.choice(["the", "Stone", "river,", "größe"]) for _ in range(rng.choice([0, 3, 90, 700])))) for i in range(60)]
    rng.shuffle(out)
    return out + [(70, None), (71, ""), (None, "last one"), (5, "again"), (5, "again"), (72, "long " * 9000)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_files_round_trip(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows()], "doc_id long, text string, file int")
    got = [tuple(r) for r in F.token_output(docs).collect()]
    start, want = 0, []
    for i, t in sorted(rows(), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        ids = PLAIN.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert F.token_output(docs.limit(0)).count() == 0


def test_random_access(tmp_path):
    w = F.Writer(f"file://{tmp_path}/x/a.arrows", False, length=8, rows=2)
    ids = np.arange(53, dtype=np.uint32)
    for lo in range(0, 53, 7):
        w.append(ids[lo : lo + 7])
    w.close()
    r = F.Reader(f"file://{tmp_path}/x/a.arrows", rows=2)
    assert r.run(5, 40).tolist() == list(range(5, 45)) and r.run(18, 9).tolist() == list(range(18, 27))
    assert np.shares_memory(r.run(17, 5), r.ids[1])
    seq, mask = r.sequence(6)
    assert seq[:5].tolist() == list(range(48, 53)) and mask.to_pylist() == [True] * 5 + [False] * 3


def test_packing(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows()], "doc_id long, text string, part int")
    got = P.pack(docs).collect()
    want = Counter()
    for i, t in rows():
        ids = PLAIN.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            want[(i, k // 2048, k, len(ids[k : k + 2048]), crc(ids[k : k + 2048]))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for places in seqs.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(seqs) <= -(-sum(r.length for r in got) // 2048) + 1
    assert P.pack(docs.limit(0)).count() == 0


def fewest(items, capacity):
    """Brute force: the fewest bins."""
    best = [len(items)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for b in sorted(set(bins)):
            if b + items[k] <= capacity:
                rest = list(bins)
                rest.remove(b)
                go(k + 1, [*rest, b + items[k]])
        go(k + 1, [*bins, items[k]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(60))
def test_reduction_keeps_the_optimum(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 13, 20])
    items = sorted((rng.randint(1 if seed % 2 else 3, capacity) for _ in range(9)), reverse=True)
    fixed, left = P.reduce_dominated(Counter(items), capacity)
    used = Counter(w for p, n in fixed for w in p * n)
    assert used + left == Counter(items) and all(sum(p) <= capacity for p, _ in fixed)
    assert sum(n for _, n in fixed) + fewest(sorted(left.elements(), reverse=True), capacity) == fewest(items, capacity)
    patterns = P.plan(Counter(items), capacity)
    assert Counter(w for p, n in patterns for w in p * n) == Counter(items)
    assert all(sum(p) <= capacity for p, _ in patterns)


def test_other_tokenizers_get_whole_texts():
    data = ["Hello World  twice\n", "", "MIXED Case, don't  é <|endoftext|>"]
    flat, sizes = Encoder("byte_bpe_50k.json")([x.encode() for x in data])
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [whole.encode(x, add_special_tokens=False).ids for x in data]
    assert sizes.tolist() == list(map(len, want)) and flat.tolist() == sum(want, [])
