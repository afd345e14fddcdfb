"""Exact top-k by inner product: a k-nearest-neighbour join over Voronoi cells.

Vectors and queries are grouped by the nearest of some pivots. For a vector x of
cell j at distance r from its pivot p_j, and a query q of cell i at distance at
most R_i from p_i and of norm at most N_i,

    |q.x - p_i.p_j| <= R_i |p_j| + N_i r

so the cells' summaries (counts, largest distances, the few vectors closest to
each pivot) bound every score from both sides. The k best lower bounds give a
score that each query of cell i surely reaches; a vector whose upper bound is
below it cannot be in any of their results and is not sent to them. Query cells
that lie close are joined into groups of about equal size, as each group gets
its own copy of what it needs.

A task never sees a cell or a group whole: queries of a group are dealt into
blocks, vectors into slices, and each pair of block and slice is solved on its
own; the best k of all slices follow. Summaries are the only thing on the
driver: at most ``PIVOTS`` cells. Where vectors don't cluster the bounds exclude
little, and the work is the whole of queries times vectors, in blocks.

* Components become floor(scale * x), as doubles. Scores are exact: where double
  arithmetic could round they are computed with whole numbers of any size, and
  those beyond a long are set to its nearest end.
* Vectors that are null or hold null, NaN or infinite components take no part,
  as queries or otherwise. Missing components of shorter vectors count as zero,
  so an empty vector scores zero everywhere.
* A query's own row is any row of its id. Other rows that repeat are ranked each
  for itself. Of query rows that share an id the smallest vector counts.
* Rows without an id are no queries; they are ranked after all ids.
* Ties go to the smaller id. Fewer than k others: all of them. No vectors or no
  queries: no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import NO_ID, cut, mix, small_batches, tidy

#: Pivots, rows of the sample they are made from, and rounds of refinement.
PIVOTS, SAMPLE, ROUNDS = 64, 2048, 5
#: Queries of a block, and bytes of the vectors of a slice, on average.
BLOCK, SLICE_BYTES = 512, 4 << 20
#: Doubles hold whole numbers exactly below this.
EXACT = float(1 << 53)
#: Widens distances and bounds by more than rounding can move them.
SLACK = 1e-9


def _matrices(vectors: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of vector; null vectors have none."""
    sizes = np.asarray(vectors.value_lengths().fill_null(-1))
    flat = vectors.flatten()
    values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan)) if len(flat) else np.zeros(0)
    starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    out = []
    for n in np.unique(sizes[sizes >= 0]):
        at = np.flatnonzero(sizes == n)
        out.append((at, values[starts[at][:, None] + np.arange(n)[None]]))
    return out


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows; missing components are zero."""
    n = min(a.shape[1], b.shape[1])
    return a[:, :n] @ b[:, :n].T


def make_pivots(sample: list[list[float]], count: int = PIVOTS) -> np.ndarray:
    """Centres of the sample after a few rounds of assignment; the sample is in a fixed order."""
    width = max(map(len, sample), default=0)
    x = np.zeros((len(sample), width))
    for i, row in enumerate(sample):
        x[i, : len(row)] = row
    x = np.unique(x, axis=0)
    centres = x[:: max(1, len(x) // count)][:count].copy()
    for _ in range(ROUNDS if len(x) else 0):
        near = np.argmin((centres**2).sum(1)[None] - 2 * (x @ centres.T), axis=1)
        for j in np.unique(near):
            centres[j] = x[near == j].mean(0)
    return centres


def assign(rows: DataFrame, scale: int, pivots: np.ndarray | None) -> DataFrame:
    """vec_id, slot, cell, gap (to the pivot, never too small), norm, x of every row that takes part.

    ``slot`` numbers rows for dealing. Without pivots, cell and gap are zero.
    """
    squares = None if pivots is None else (pivots**2).sum(1)

    def run(batches):
        begin, seen = np.uint64(TaskContext.get().partitionId()) << np.uint64(40), 0
        for b in batches:
            b = pa.Table.from_batches([b]).combine_chunks()
            ids, vectors = b.column(0).combine_chunks(), b.column(1).combine_chunks()
            for at, raw in _matrices(vectors):
                fine = np.isfinite(raw).all(axis=1)
                at, x = at[fine], np.floor(raw[fine] * float(scale)) + 0.0
                if not len(at):
                    continue
                slot = mix(begin + np.arange(seen, seen + len(at)).astype(np.uint64)) >> np.uint64(1)
                seen += len(at)
                own = (x**2).sum(1)
                cell, gap = np.zeros(len(at), np.int32), np.zeros(len(at))
                if pivots is not None:
                    far = own[:, None] + squares[None] - 2 * _dot(x, pivots)
                    cell = np.argmin(far, axis=1).astype(np.int32)
                    far = np.maximum(far[np.arange(len(at)), cell], 0) + 1e-11 * (own + squares[cell])
                    gap = np.sqrt(far) * (1 + SLACK)
                offsets = np.arange(len(at) + 1, dtype=np.int32) * x.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at)), pa.array(slot.astype(np.int64)), pa.array(cell), pa.array(gap), pa.array(np.sqrt(own) * (1 + SLACK)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))],
                    names=["vec_id", "slot", "cell", "gap", "norm", "x"],
                )

    return rows.mapInArrow(tidy(run), "vec_id long, slot long, cell int, gap double, norm double, x array<double>")


def closest(data: DataFrame, k: int) -> DataFrame:
    """cell, vec_id, gap and norm of the k vectors of different ids closest to each pivot (the best of each task's best), and a row with the count n a cell."""

    def run(batches):
        best: dict[int, dict] = {}
        count: dict[int, int] = {}
        for b in batches:
            ids = np.asarray(b.column(0).fill_null(NO_ID))
            cell, gap, norm = (np.asarray(b.column(i)) for i in (1, 2, 3))
            for c in np.unique(cell).tolist():
                at = np.flatnonzero(cell == c)
                count[c] = count.get(c, 0) + len(at)
                mine = best.setdefault(c, {})
                for i in at[np.argsort(gap[at], kind="stable")].tolist():
                    v = ids[i].item()
                    if len(mine) >= k and gap[i] >= max(g for g, _ in mine.values()):
                        break
                    if v not in mine or gap[i] < mine[v][0]:
                        mine[v] = (gap[i].item(), norm[i].item())
                    if len(mine) > k:
                        del mine[max(mine, key=lambda u: mine[u][0])]
        rows = [(c, 0, v, g, m) for c, mine in best.items() for v, (g, m) in mine.items()] + [(c, n, None, None, None) for c, n in count.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()], strict=True)], names=["cell", "n", "vec_id", "gap", "norm"])

    found = data.select("vec_id", "cell", "gap", "norm").mapInArrow(tidy(run), "cell int, n long, vec_id long, gap double, norm double")
    once = found.groupBy("cell", "vec_id").agg(F.sum("n").alias("n"), F.min(F.struct("gap", "norm")).alias("near"))
    order = F.row_number().over(Window.partitionBy("cell").orderBy(F.asc_nulls_first("near.gap"), "vec_id"))  # the count comes first
    return once.withColumn("order", order).where(F.col("order") <= k + 1).select("cell", "n", "vec_id", "near.gap", "near.norm")


def bounds(pivots: np.ndarray, near: list[tuple], asked: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray]:
    """For query cells (rows) and pivots (columns): the distance from the pivot at which a vector first matters.

    ``near``: (cell, gap, norm) of known vectors, k + 1 different ids a cell, as
    one of them may be a query's own. ``asked``: (cell, largest gap, largest norm).
    """
    cells = np.array([a[0] for a in asked])
    radius, norm = (np.array([a[i] for a in asked]) for i in (1, 2))
    inner, size = pivots[cells] @ pivots.T, np.sqrt((pivots**2).sum(1))
    spread = radius[:, None] * size[None]
    loose = SLACK * (np.abs(inner) + spread + norm[:, None] * size[None] + 1)
    at, gap = np.array([n[0] for n in near], int), np.array([n[1] for n in near], float)
    low = inner[:, at] - spread[:, at] - norm[:, None] * gap[None] - loose[:, at]
    sure = np.sort(low, axis=1)[:, -(k + 1)] if len(near) > k else np.full(len(cells), -np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        first = (sure[:, None] - loose - inner - spread) / norm[:, None]
    first[np.isnan(first) | (norm[:, None] == 0)] = -np.inf
    return cells, first - SLACK * np.abs(np.where(np.isfinite(first), first, 0))


def group_cells(pivots: np.ndarray, cells: np.ndarray, counts: np.ndarray, block: int) -> np.ndarray:
    """A group for each query cell: from the farthest cell left, the closest ones join until a group has its share of the queries."""
    groups = min(len(cells), max(1, -(-int(counts.sum()) // block)))
    share = counts.sum() / groups
    out, at, left = np.full(len(cells), -1), pivots[cells], set(range(len(cells)))
    centre = at.mean(0)
    for g in range(groups):
        if not left:
            break
        rest = sorted(left)
        seed = rest[int(np.argmax(((at[rest] - centre) ** 2).sum(1)))]
        total = 0
        for i in sorted(rest, key=lambda i: (((at[i] - at[seed]) ** 2).sum(), i)):
            if total and g < groups - 1 and total + counts[i] / 2 > share:
                break
            out[i], total = g, total + counts[i]
            left.discard(i)
    return out


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products as longs."""
    n = min(q.shape[1], x.shape[1])
    q, x = q[:, :n], x[:, :n]
    if not n:
        return np.zeros((len(q), len(x)), np.int64)
    if np.abs(q).max() * np.abs(x).max() * n < EXACT:
        return (q @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m.tolist()], object)
    top = (1 << 63) - 1
    return np.array([[min(max(int(v), -top - 1), top) for v in row] for row in whole(q) @ whole(x).T], np.int64)


def solve(k: int):
    """The k best of a slice for every query of a block."""

    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = []
        if queries.num_rows and data.num_rows:
            qid, vid = np.asarray(queries.column("query_id").combine_chunks()), np.asarray(data.column("vec_id").combine_chunks().fill_null(NO_ID))
            parts = _matrices(data.column("x").combine_chunks())
            for rows, q in _matrices(queries.column("x").combine_chunks()):
                ids = np.concatenate([vid[at] for at, _ in parts])
                for lo in range(0, len(rows), 64):  # 64 x slice scores at once
                    mine = qid[rows[lo : lo + 64]]
                    score = np.concatenate([_scores(q[lo : lo + 64], x) for _, x in parts], axis=1)
                    other = ids[None] != mine[:, None]
                    for i in range(len(mine)):
                        at = np.flatnonzero(other[i])
                        s = score[i, at]
                        if len(at) > k:
                            edge = np.partition(s, len(s) - k)[len(s) - k]
                            at = at[s >= edge]
                            s = score[i, at]
                        best = np.lexsort((ids[at], -1 - s))[:k]  # -1 - s orders downwards without overflow
                        out.append([np.full(len(best), mine[i]), ids[at[best]], s[best]])
        query, vec, score = (np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else ([], [], [])))
        return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(vec, pa.int64(), mask=vec == NO_ID), "score": pa.array(score, pa.int64())})

    return run


def exact_topk(rows: DataFrame, asked: Column, k: int = 5, scale: int = 256, pivots: int = PIVOTS, block: int = BLOCK, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of every row that ``asked`` (on vec_id) takes as a query."""
    spark = rows.sparkSession
    small_batches(spark)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("embedding"))
    whole = ~F.exists("embedding", lambda v: F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(True)))
    sample = rows.where(F.col("embedding").isNotNull() & whole).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)
    centres = make_pivots([r.x for r in assign(sample, scale, None).select("x").collect()], pivots)
    schema = "query_id long, rank int, vec_id long, score long"
    if not len(centres):
        return spark.createDataFrame([], schema)
    data = cut(assign(rows, scale, centres), "vectors")
    ask = cut(
        data.where(F.col("vec_id").isNotNull() & asked)
        .groupBy("vec_id")
        .agg(F.min(F.struct("x", "cell", "gap", "norm", "slot")).alias("q"))
        .select(F.col("vec_id").alias("query_id"), "q.*"),
        "queries",
    )
    told = ask.groupBy("cell").agg(F.max("gap").alias("gap"), F.max("norm").alias("norm"), F.count(F.lit(1)).alias("n")).orderBy("cell").collect()  # a row a cell
    if not told:
        return spark.createDataFrame([], schema)
    near = closest(data, k + 1).collect()  # k + 2 rows a cell
    total = sum(r.n for r in near)
    known = {r.vec_id: (r.cell, r.gap, r.norm) for r in near if r.gap is not None}  # each id once
    cells, first = bounds(centres, list(known.values()), [(r.cell, r.gap, r.norm) for r in told], k)
    counts = np.array([r.n for r in told])
    group = group_cells(centres, cells, counts, block)
    blocks = {g: max(1, -(-int(counts[group == g].sum()) // block)) for g in set(group.tolist())}
    slices = max(1, -(-total * 8 * max(1, centres.shape[1]) // slice_bytes))
    needs = [(j, g, blocks[g], float(first[group == g, j].min())) for g in blocks for j in range(len(centres))]  # at most pivots x pivots rows
    deal = lambda n: F.pmod(F.col("slot"), F.lit(n).cast("long"))
    slice_of = deal(slices).alias("slice")
    sent = (
        data.join(F.broadcast(spark.createDataFrame(needs, "cell int, grp int, blocks int, first double")), "cell")
        .where(F.col("gap") >= F.col("first"))
        .select("grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), slice_of, "vec_id", "x")
    )
    homes = spark.createDataFrame([(int(c), int(g), blocks[g]) for c, g in zip(cells, group.tolist(), strict=True)], "cell int, grp int, blocks int")
    put = ask.join(F.broadcast(homes), "cell").select("grp", F.pmod(F.col("slot"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice"), "query_id", "x")
    keys = ["grp", "block", "slice"]
    solved = put.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(solve(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return solved.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
