import numpy as np
import pytest

from graphloom.operators import lineage, vectors

SCHEMA = "vec_id long, embedding array<float>, v string"


def frame(spark, m, ids=None):
    rows = [(int(i), [float(x) for x in v], "") for i, v in zip(ids if ids is not None else range(len(m)), m, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def clustered(n=1500, dims=16, centres=30, seed=1):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(centres, dims))[rng.integers(0, centres, n)] + 0.3 * rng.normal(size=(n, dims))).astype(np.float32)


def brute(m, asked, k, metric):
    m = m.astype(float)
    out = set()
    for q in asked:
        if metric == "l2":
            s = np.round(np.sqrt(((m - m[q]) ** 2).sum(1)), 12)
        else:
            s = -np.round((m @ m[q]) / (np.linalg.norm(m, axis=1) * np.linalg.norm(m[q]) if metric == "cosine" else 1), 12)
        order = [i for i in np.lexsort((np.arange(len(m)), s)) if i != q][:k]
        out |= {(q, int(i), r + 1) for r, i in enumerate(order)}
    return out


def ranks(df):
    return {(r.query_id, r.id, r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_exact_and_all_cells_equal_all_pairs(spark, metric, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 40)
    monkeypatch.setattr(vectors, "SLICE_ROWS", 300)
    m = clustered()
    df, asked = frame(spark, m), list(range(0, 1500, 10))
    want = brute(m, asked, 7, metric)
    queries = df.filter("vec_id % 10 = 0")
    assert ranks(vectors.nearest(df, queries, 7, metric)) == want
    index = vectors.build(df, lineage.scratch(spark), metric)
    assert index.cells == int(2 * 1500**0.5) and index.counts.sum() == 1500
    assert ranks(vectors.search(index, queries, 7, index.cells)) == want


def test_measured_probes_reach_the_recall(spark):
    df = frame(spark, clustered(3000, seed=2))
    index = vectors.build(df, lineage.scratch(spark))
    probes = vectors.probes_for(index, spark, 10)
    assert 1 <= probes < index.cells / 2
    queries = df.filter("vec_id % 20 = 0")
    told = vectors.recall_of(vectors.search(index, queries, 10, probes), vectors.nearest(df, queries, 10)).agg({"hits": "sum", "wanted": "sum"}).first()
    assert told["sum(hits)"] / told["sum(wanted)"] >= 0.9 and told["sum(wanted)"] == 1500


def test_added_vectors_are_found_after_loading(spark):
    m = clustered(400)
    path = lineage.scratch(spark)
    index = vectors.build(frame(spark, m[:300]), path, cells=16)
    vectors.add(index, frame(spark, m[300:], range(300, 400)))
    again = vectors.load(spark, path)
    assert again.counts.sum() == 400 and again.metric == "cosine"
    assert ranks(vectors.search(again, frame(spark, m).filter("vec_id % 10 = 0"), 5, 16)) == brute(m, range(0, 400, 10), 5, "cosine")


def test_a_cell_of_copies_is_split(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 20)
    monkeypatch.setattr(vectors, "SLICE_ROWS", 50)
    m = clustered(600)
    m[:200] = m[0]
    index = vectors.build(frame(spark, m), lineage.scratch(spark))
    assert ranks(vectors.search(index, frame(spark, m).filter("vec_id % 5 = 0"), 6, index.cells)) == brute(m, range(0, 600, 5), 6, "cosine")


def test_rows_that_take_no_part(spark):
    rows = [(1, [1.0, 0.0], ""), (2, [0.0, 1.0], ""), (3, None, ""), (4, [None, 1.0], ""), (None, [1.0, 1.0], ""), (5, [0.0, 0.0], "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, vectors.nearest(df, df, 5).collect()))
    assert got == [(1, 2, 0.0, 1), (1, 5, 0.0, 2), (2, 1, 0.0, 1), (2, 5, 0.0, 2), (5, 1, 0.0, 1), (5, 2, 0.0, 2)]
    index = vectors.build(df, lineage.scratch(spark))
    assert sorted(map(tuple, vectors.search(index, df, 5, index.cells).collect())) == got


def test_empty(spark):
    none, some = frame(spark, []), frame(spark, clustered(20))
    index = vectors.build(none, lineage.scratch(spark))
    assert vectors.search(index, some, 3, 4).collect() == [] == vectors.search(vectors.build(some, lineage.scratch(spark)), none, 3, 4).collect()
    assert vectors.probes_for(index, spark, 3) == 1
    assert vectors.nearest(none, some, 3).collect() == [] == vectors.nearest(some, none, 3).collect()
