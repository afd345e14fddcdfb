"""The pipeline and each of its stages against a plain version of the same decisions."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from graphloom.llm import quality as Q
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_simhash import brute_fp


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    vocab = [a + b for a in ("ka", "lo", "mi", "né", "ru", "so") for b in ("", "ta", "vel", "n")]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = say(60)
    items = [(i, say(12)) for i in range(5)]
    docs = []
    for i in range(90):
        t = say(rng.choice([8, 40, 200, 900]))
        if i % 9 == 1:
            t = t + " " + passage + " " + say(20)
        if i % 13 == 2:
            t = t + " " + rng.choice(items)[1] + " " + say(6)
        if i % 5 == 3:
            t = " ".join(w.upper() + "!!" for w in t.split())
        if i % 10 == 7:
            t = docs[-1][1]
        docs.append((i, t, "xx", f"s{i % 3}", len(t)))
    docs.append((90, None, None, None, None))
    folder = f"file://{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int("!!" not in (t or "")), 0) for i, t, *_ in docs[:60]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, items


def plain(docs, items, labels, spark):
    train = [(spark.sql(f"SELECT xxhash64({i}L)").first()[0], i, y) for i, y in labels.items() if zlib.crc32(str(i).encode()) % 4 != 2]
    text = {i: t or "" for i, t, *_ in docs}
    h = Q.Hasher()
    bias, w = Q.train([h(text[i].encode()) for _, i, _ in sorted(train)], [y for _, _, y in sorted(train)])

    def score(t):
        i, x = h((t or "").encode())
        return Q.sigmoid(bias + float(w[i] @ x))

    one = [d for d in docs if score(d[1]) >= Q.THRESHOLD]
    prints = [brute_fp(d[1]) for d in one]
    root = list(range(len(one)))
    for a in range(len(one)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    two = [d for k, d in enumerate(one) if root[k] == k]  # in id order: the first of a group has the smallest id
    first = {}
    for i, t, *_ in two:
        raw = (t or "").encode()
        for k in range(len(raw) - 99):
            first.setdefault(raw[k : k + 100], (i, k))
    three = []
    for i, t, lang, source, n in two:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 99):
            if first[raw[k : k + 100]] < (i, k):
                gone[k : k + 100] = True
        if gone.any():
            t = bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
            n = len(t)
            if not t.strip():
                continue
        three.append((i, t, lang, source, n))
    hit = {r[0] for r in brute_hits([(i, t) for i, t, *_ in three], items) if r[5]}
    four = [d for d in three if d[0] not in hit]
    return [one, two, three, four]


def test_stages(spark, tables):
    folder, docs, items = tables
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    wants = plain(docs, items, labels, spark)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "simhash near-dedup", "suffix-array dedup", "benchmark decontamination", "best-fit packing"]
    assert all(a != b for a, b in zip([docs, *wants], wants))  # every stage has something to do
    columns = frame.columns
    for (name, stage), want in zip(corpus_pipeline.STAGES, wants):
        out = stage(spark, frame, folder)
        assert out.columns == columns, name
        rows = [tuple(r) for r in out.collect()]
        assert sorted(rows, key=str) == sorted(want, key=str), name
        frame = spark.createDataFrame(rows, frame.schema)
    check_packing(corpus_pipeline.STAGES[-1][1](spark, frame, folder).collect(), wants[-1])
    check_packing(corpus_pipeline.run(spark, folder).collect(), wants[-1])


def check_packing(rows, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t, *_ in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            want[(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for places in used.values():
        assert [o for o, _ in sorted(places)] == [sum(n for _, n in sorted(places)[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 2048


def test_columns_of_any_name_pass_every_stage(spark, tables):
    folder, docs, items = tables
    names = ["__blobs", "__id", "__dk", "a.b", "row", "fp", "score", "shard"]
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    plain_rows = {tuple(r) for r in frame.collect()}
    wide = frame.selectExpr("*", *(f"concat('{k}', doc_id) AS `{n}`" for k, n in enumerate(names)))
    assert plain_rows
    narrow = frame
    for name, stage in corpus_pipeline.STAGES[:-1]:
        narrow, wide_out = stage(spark, narrow, folder), stage(spark, wide, folder)
        assert wide_out.columns == wide.columns, name
        rows = [tuple(r) for r in wide_out.collect()]
        assert sorted((r[: len(frame.columns)] for r in rows), key=str) == sorted(map(tuple, narrow.collect()), key=str), name
        assert all(r[len(frame.columns) + k] == (None if r[0] is None else f"{k}{r[0]}") for r in rows for k in range(len(names))), name
        wide = spark.createDataFrame(rows, wide.schema)
        narrow = spark.createDataFrame([r[: len(frame.columns)] for r in rows], frame.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, wide, folder).count() > 0


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_an_empty_table(spark, tables, tmp_path, empty):
    folder, docs, items = tables
    for name in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        (df.limit(0) if name == empty else df).write.parquet(f"file://{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    if empty == "documents":
        assert got == []
    else:
        assert len({r.doc_id for r in got}) > 20
    frame = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    if empty == "labels":  # nothing to learn from: all rows are kept
        assert corpus_pipeline.quality_filter(spark, frame, f"file://{tmp_path}").count() == len(docs)
    if empty == "benchmark":
        assert corpus_pipeline.decontamination(spark, frame, f"file://{tmp_path}").count() == len(docs)
