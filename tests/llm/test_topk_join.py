import math
import random

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import topk_join as T12

SCHEMA = "vec_id long, embedding array<float>, cell int, `x.y` string"


def brute(rows, asked, k=5, scale=256):
    """Every query against every row, in whole numbers."""
    ok = [(i, [math.floor(scale * float(np.float32(v))) for v in x]) for i, x in rows if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    queries = {}
    for i, x in ok:
        if i is not None and asked(i):
            queries[i] = min(x, queries.get(i, x))
    top = (1 << 63) - 1
    out = []
    for q, x in queries.items():
        scored = [(max(min(sum(a * b for a, b in zip(x, y, strict=False)), top), -top - 1), i) for i, y in ok if i != q]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def found(spark, rows, asked=lambda c: c % 10 == 0, **how):
    df = spark.createDataFrame([(i, x, 1, "") for i, x in rows], SCHEMA).repartition(6)
    return sorted(map(tuple, T12.exact_topk(df, asked(F.col("vec_id")), **how).collect()), key=repr)


def clustered(rng, n, dims=12, centres=6):
    mid = rng.normal(size=(centres, dims))
    return [(i, [float(v) for v in mid[i % centres] + rng.normal(size=dims) * 0.01]) for i in range(n)]


def test_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=16)]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # ties with larger ids
    for how in ({}, {"pivots": 5, "block": 7, "slice_bytes": 3000}, {"pivots": 1}, {"k": 1}, {"k": 600}):
        assert found(spark, rows, **how) == brute(rows, lambda i: i % 10 == 0, how.get("k", 5))


def test_clusters_are_pruned_and_equal_all_pairs(spark):
    rows = clustered(np.random.default_rng(2), 600)
    assert found(spark, rows, pivots=12, block=10, slice_bytes=4000) == brute(rows, lambda i: i % 10 == 0)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    x = np.floor(256 * np.array([r[1] for r in rows], np.float32).astype(float))
    pivots = T12.make_pivots(x.tolist(), 12)
    data = T12.assign(df, 256, pivots).cache()
    near = [(r.cell, r.gap, r.norm) for r in T12.closest(data, 6).collect() if r.gap is not None]
    told = data.where("vec_id % 10 = 0").groupBy("cell").agg(F.max("gap").alias("gap"), F.max("norm").alias("norm")).collect()
    cells, first = T12.bounds(pivots, near, [(r.cell, r.gap, r.norm) for r in told], 5)
    own = {r.vec_id: (r.cell, r.gap) for r in data.collect()}
    sent = np.array([[own[i][1] >= first[c, own[i][0]] for i in own] for c in range(len(cells))])
    assert sent.mean() < 0.5  # most vectors are not sent to most query cells
    data.unpersist()


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, []), (6, [3.0]), (7, [1.0, 1.0, 9.0]), (None, [2.0, 2.0]), (None, [5.0, 5.0]), (10, [-1.0, -1.0]), (20, []), (30, None)]
    rows += [(8, [0.5, 0.5])] * 4 + [(0, [1.0, 2.0])] * 3 + [(10, [-2.0, 4.0])]
    assert found(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_a_hot_group_of_copies(spark):
    rng = random.Random(3)
    rows = [(i, [1.0, 0.5, -0.25]) for i in range(0, 300)] + [(i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(300, 500)]
    assert found(spark, rows, block=4, slice_bytes=500) == brute(rows, lambda i: i % 10 == 0)


def test_large_components_stay_exact(spark):
    rows = [(0, [3.0e5, 1.0]), (1, [3.0e5, 1.0]), (2, [3.0e5, 1.0 + 2**-7]), (3, [-3.0e5, 0.0]), (4, [2.0e30, 1.0]), (10, [-2.0e38, 7.0]), (11, [2.0e38, -7.0])]
    rows += [(12, [1.6777216e7 * 4, 0.0078125]), (20, [1.6777216e7 * 4, 3.0])]
    assert found(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0]), (3, [2.0])]) == []
    assert found(spark, [(0, [1.0])]) == []
    assert found(spark, [(0, None)]) == []
