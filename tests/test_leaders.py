import numpy as np
import pytest

from graphloom.operators import leaders as L

SCHEMA = "vec_id long, embedding array<double>, leader string"


def greedy(m, threshold):
    """The plain loop: rows in order, each to the first leader that is close."""
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    close = np.round(u @ u.T, 9) >= threshold
    leader, lead = {}, []
    for i in range(len(m)):
        first = next((j for j in lead if close[i, j]), i)
        leader[i] = first
        if first == i:
            lead.append(i)
    return leader


def chained(n, seed=1, dims=24, centres=300, noise=0.045):
    """Groups whose members are near the threshold of each other, so that chains form."""
    rng = np.random.default_rng(seed)
    mid = rng.normal(size=(centres, dims))
    mid /= np.linalg.norm(mid, axis=1, keepdims=True)
    return mid[rng.integers(0, centres, n)] + noise * rng.normal(size=(n, dims))


def run(spark, m, **how):
    df = spark.createDataFrame([(i, [float(x) for x in v], "x") for i, v in enumerate(m)], SCHEMA).repartition(6)
    return {r.id: r.leader for r in L.leaders(df, **how).collect()}


def test_equals_the_loop_on_5000_rows(spark):
    m = chained(5000)
    want = greedy(m, 0.92)
    assert 300 < len(set(want.values())) < 4000
    assert run(spark, m) == want


@pytest.mark.parametrize("local", [0, 10**6])
def test_small_heads_need_passes_and_change_nothing(spark, local):
    m = chained(400, seed=2, centres=4, noise=0.05)
    assert run(spark, m, head=20, keep=2, local_edges=local) == greedy(m, 0.92)


def test_a_hot_bucket_of_copies_and_near_copies(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(1500, 16))
    m[::3] = m[0]
    m[1::3] = m[1] + 1e-3 * rng.normal(size=(500, 16))
    assert run(spark, m, head=64) == greedy(m, 0.92)


def test_pairs_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(L, "HEAD", 30)
    m = chained(600, seed=4, centres=40)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    close = np.round(u @ u.T, 9)
    df = spark.createDataFrame([(i, [float(x) for x in v], "x") for i, v in enumerate(m)], SCHEMA)
    got = {(r.id, r.near) for r in L.similar_pairs(df).collect()}
    assert got == {(i, j) for i in range(600) for j in range(i) if close[i, j] >= 0.92}


def test_rows_that_lead_themselves(spark):
    rows = [(1, None, ""), (2, [0.0, 0.0], ""), (3, [0.0, 0.0], ""), (4, [1.0, None], ""), (5, [1.0, 0.0], ""), (6, [2.0, 0.0], ""), (6, [3.0, 0.0], ""), (None, [1.0, 0.0], ""), (9, [1.0, 0.0], "")]
    got = {r.id: r.leader for r in L.leaders(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 9: 5}
    assert L.leaders(spark.createDataFrame([], SCHEMA)).collect() == []


def test_unique_questions(spark):
    q = spark.createDataFrame([(1, " Who sang? ", "Emma", "a"), (2, "who sang?", "Luca", "a"), (3, "Where?", None, "b"), (4, "who sang", " ", "c")], "id long, text string, persona string, kind string")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.99, 0.05])], "id long, v array<double>")
    kept, members = L.unique_questions(q, v)
    assert sorted(map(tuple, kept.collect())) == [(1, "who sang?", 3, "Emma; Luca", "a; c"), (3, "where?", 1, "", "b")]
    assert {r.id: r.leader for r in members.collect()} == {1: 1, 2: 1, 3: 3, 4: 1}


def test_a_low_threshold_deals_no_row_into_hundreds_of_buckets(spark, monkeypatch):
    assert L.bands_for(100_000, 0.4) == (0, 1) and L.bands_for(1_000_000, 0.4) == (0, 1)
    bits, bands = L.bands_for(1_000_000, 0.92)
    assert bits and bands < 200
    monkeypatch.setattr(L, "BLOCK_BYTES", 64 * 8 * 50)
    monkeypatch.setattr(L, "AT_ONCE", 1000)
    monkeypatch.setattr(L, "EXACT", 640)
    m = np.random.default_rng(6).normal(size=(700, 64)).astype(np.float32).astype(float)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    close = np.round(u @ u.T, 9)
    df = spark.createDataFrame([(i, [float(x) for x in v], "x") for i, v in enumerate(m)], SCHEMA.replace("double", "float"))
    found = L.similar_pairs(df, 0.4).collect()
    assert len(found) == len({(r.id, r.near) for r in found})
    assert {(r.id, r.near) for r in found} == {(i, j) for i in range(700) for j in range(i) if close[i, j] >= 0.4}
    assert {r.id: r.leader for r in L.leaders(df, 0.4, head=40, keep=3).collect()} == greedy(m, 0.4)


def test_buckets_of_bands_still_find_all(spark, monkeypatch):
    monkeypatch.setattr(L, "bands_for", lambda n, threshold: (6, 60))
    monkeypatch.setattr(L, "HEAD", 30)
    m = chained(600, seed=4, centres=40)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    close = np.round(u @ u.T, 9)
    df = spark.createDataFrame([(i, [float(x) for x in v], "x") for i, v in enumerate(m)], SCHEMA)
    assert {(r.id, r.near) for r in L.similar_pairs(df).collect()} == {(i, j) for i in range(600) for j in range(i) if close[i, j] >= 0.92}
    assert run(spark, m, head=20, keep=2) == greedy(m, 0.92)
