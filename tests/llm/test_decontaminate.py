import hashlib
import random
import re

from graphloom.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def toks(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = toks(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(None if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, found = toks(t), set(), set()
        for win, ids in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found |= ids
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found - {None})).encode()).hexdigest(), bool(hit)))
    return out


def case():
    rng = random.Random(3)
    vocab = ["a", "b", "c", "the", "Ünder", "x1"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.choice([3, 10, 12, 25]))) for i in range(12)] + [(12, None), (13, ""), (14, "?!"), (None, say(5)), (3, "a b")]
    docs = [(i, say(rng.randint(0, 60)) + rng.choice(["", " ", "! "]) + rng.choice(items)[1].__str__()) for i in range(40)]
    docs += [(40, None), (41, ""), (41, ""), (None, items[0][1]), (42, items[1][1] * 400)]
    return docs, items


def test_matches_brute_force(spark, monkeypatch):
    docs, items = case()
    frame = spark.createDataFrame([(d, t, "en") for d, t in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(str, brute(docs, items)))
    assert sorted(str(tuple(r)) for r in D.contamination(frame, bench).collect()) == want
    monkeypatch.setattr(D, "blocks", lambda b, i, t: [b.filter("pmod(coalesce(item_id, 0), 2) = 0"), b.filter("pmod(item_id, 2) = 1")])
    assert sorted(str(tuple(r)) for r in D.contamination(frame, bench).collect()) == want
    kept = D.drop_contaminated(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(x[0]) for x in brute(docs, items) if not x[5])


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert D.contamination(docs.limit(0), bench).count() == 0
    assert [r.contaminated for r in D.contamination(docs, bench.limit(0)).collect()] == [False]


def test_proximity():
    w = D.compile_windows([(1, b"alpha beta gamma")])
    shard = D.index_shard([b"alpha x beta gamma", b"alpha beta", b"gamma"], w.vocabulary)
    assert len(D.search(shard, w)[0]) == 0
    assert len(D.search(shard, w, slop=1)[0]) == 1


def test_one_block_at_a_time(spark, monkeypatch):
    """With blocks of 1 KB: as many searches as blocks, and never two live broadcasts of windows."""
    docs, items = case()
    items = items + [(100 + k, " ".join(f"w{k}x{j}" for j in range(40))) for k in range(40)] + [(200, items[0][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    live, most, searches = set(), [0], [0]
    real = D.search_index

    def watched(index, windows, slop=0):
        hits = real(index, windows, slop)
        shared, searches[0] = hits._graphloom_broadcast, searches[0] + 1
        live.add(shared)
        most[0] = max(most[0], len(live))
        end = shared.destroy
        shared.destroy = lambda: (live.discard(shared), end())
        return hits

    monkeypatch.setattr(D, "search_index", watched)
    monkeypatch.setattr(D, "BLOCK_BYTES", 1024)
    got = sorted(str(tuple(r)) for r in D.contamination(frame, bench).collect())
    assert got == sorted(map(str, brute(docs, items)))
    assert searches[0] > 5 and most[0] == 1


def chains(words, window, slop):
    """Words inside any chain, by trying all of them."""
    ends = {}

    def follow(k, at):
        if k == len(window):
            return [at]
        return [e for p in range(at + 1, min(at + 2 + slop, len(words))) if words[p] == window[k] for e in follow(k + 1, p)]

    hit = set()
    for p, w in enumerate(words):
        if w == window[0]:
            for e in follow(1, p):
                hit.update(range(p, e + 1))
    return hit


def test_proximity_does_not_depend_on_shards(spark, monkeypatch):
    rng = random.Random(12)
    say = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    items = [(i, say(rng.choice([2, 3, 4, 6]))) for i in range(15)]
    docs = [(i, say(rng.randint(0, 80))) for i in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for slop in (1, 3):
        want = {}
        for d, t in docs:
            hits = [chains(toks(t), toks(x), slop) for _, x in items]
            want[d] = (len(set().union(*hits)), sum(map(bool, hits)))
        for shards in (1, 3, 50):
            got = D.contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(shards), bench, slop=slop).collect()
            assert {r.doc_id: (r.n_hit, r.n_items) for r in got} == want


def test_items_without_an_id_are_found(spark):
    bench = spark.createDataFrame([(None, "alpha beta"), (None, "gamma"), (7, "gamma")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x alpha beta y"), (2, "gamma"), (3, "x")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in D.contamination(docs, bench).collect()}
    ids = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {1: (2, 1, ids(""), True), 2: (1, 2, ids("7"), True), 3: (0, 0, ids(""), False)}
    assert [r.doc_id for r in D.drop_contaminated(docs, bench).collect()] == [3]


def test_a_block_of_windows_is_small():
    import pickle
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(5)
    vocab = [f"word{i}" for i in range(150_000)]
    data = [" ".join(rng.choice(vocab) for _ in range(400)) for _ in range(2200)]
    assert sum(map(len, data)) > 8_000_000
    ids, texts = pa.array([str(i) for i in range(len(data))]), pa.array([t.encode() for t in data], pa.large_binary())
    begin = pa.total_allocated_bytes()
    tracemalloc.start()
    w = D.compiled(ids, texts)
    python, kept = tracemalloc.get_traced_memory()[1], pa.total_allocated_bytes() - begin
    tracemalloc.stop()
    sent = len(pickle.dumps(w))
    assert len(w.lengths) > 800_000 and python < 100 << 20 and kept < 50 << 20 and sent < 40 << 20


def test_equal_rows_are_one_small_block(spark):
    text = " ".join(f"t{i}" for i in range(500))
    bench = spark.createDataFrame([(1, text)], "item_id long, text string").crossJoin(spark.range(10_000)).drop("id")
    parts = list(D.blocks(bench, "item_id", "text"))
    assert len(parts) == 1 and len(D.windows_of(parts[0]).lengths) == 491
