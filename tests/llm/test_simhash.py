import itertools
import random

import numpy as np
import xxhash

from graphloom.llm import simhash as S


def brute_fp(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute_groups(rows):
    rows = [(S.NO_ID if i is None else i, brute_fp(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if (rows[a][1] ^ rows[b][1]).bit_count() <= 2:
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), S.NO_ID), i)
    clean = lambda i: None if i == S.NO_ID else i
    return sorted(str((clean(i), f"{fp:016x}", clean(least[find(k)]))) for k, (i, fp) in enumerate(rows))


def corpus(seed=1):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(n))
    rows = [(0, None), (1, ""), (2, "One"), (3, "one"), (4, "two words"), (None, "two words"), (None, say(50)), (6, "x y z"), (6, "x y z"), (6, "other text of it")]
    for i in range(30):
        base = say(rng.choice([40, 300, 900]))
        for j in range(4):
            words = base.split(" ")
            for _ in range(j):
                words[rng.randrange(len(words))] = "edit"
            rows.append((100 + 10 * i + j, " ".join(words)))
    return rows


def test_golay_tables():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 1 << 23, 3000)
    keys = S.codewords(words)
    assert {len(set(k)) for k in keys.tolist()} == {1, 6}
    for flips in (1, 2):
        other = words.copy()
        for w in range(len(words)):
            for b in rng.choice(23, flips, replace=False):
                other[w] ^= 1 << int(b)
        assert all(set(a) & set(b) for a, b in zip(keys.tolist(), S.codewords(other).tolist()))


def test_groups_match_brute_force(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, fp string")
    assert sorted(str(tuple(r)) for r in S.simhash_groups(docs).collect()) == brute_groups(rows)
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    # two texts under id 6 are no near-duplicates: their groups share a component_id
    assert kept.count() == len({x.rsplit(",", 1)[1] for x in brute_groups(rows)}) + 1
    assert S.simhash_groups(docs.limit(0)).count() == 0


def test_large_buckets(spark, monkeypatch):
    rng = random.Random(2)
    fps, seen = [rng.getrandbits(64)], set()
    for _ in range(300):
        fp = rng.choice(fps)
        for _ in range(rng.choice([1, 2, 3, 5])):
            fp ^= 1 << rng.randrange(64)
        fps.append(fp)
    fps = sorted(set(fps))
    monkeypatch.setattr(S, "BUCKET", 2)
    nodes = spark.createDataFrame([(S._signed(f),) for f in fps], "fp long")
    got = S.components(S.links(nodes), "a", "b").collect()
    root = {r.node: r.root for r in got}
    mine = {f: root.get(S._signed(f), S._signed(f)) for f in fps}
    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 2:
            assert mine[a] == mine[b]
            seen.add(mine[a])
    assert seen
