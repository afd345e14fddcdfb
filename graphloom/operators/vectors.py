"""Vector search: exact, and by an inverted index of cells (IVF-flat).

Both solve blocks of queries against slices of vectors, one pair of block and
slice a group, and keep the best k of all slices: no query passes through the
driver, no table is held by a task, and any number of queries is one job.

``build`` trains cells by k-means on a bounded sample, assigns every vector to
its cell and writes the cells as a table partitioned by cell. ``search`` sends a
query to the cells it probes and reads those cells only. Probing every cell gives
the exact result. ``probes_for`` measures, on a bounded sample of the vectors,
how many cells must be probed for a recall. Cells' centres are the only thing
that is broadcast: at most ``MAX_CELLS`` of them, and fewer where vectors are so
long that they would pass ``CENTRE_BYTES``.

Rows with a null id, null vector or null component take no part. Vectors of zero
length score 0 under cosine. Vectors of another length than the first are an
error. Other columns are not read. An empty index finds nothing.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.lineage import cut

#: Queries of a block and vectors of a slice, on average.
QUERY_BLOCK, SLICE_ROWS = 512, 8192
#: Cells of an index: twice the root of its vectors, within these.
MIN_CELLS, MAX_CELLS = 16, 4096
#: What the centres of all cells may take.
CENTRE_BYTES = 32 << 20
#: Vectors that train the cells (for each cell, and altogether), and rounds of training.
TRAIN_EACH, TRAIN_ROWS, ROUNDS = 64, 65_536, 10
#: Numbers that one step of finding rows' cells holds.
STEP_VALUES = 1 << 20
#: Queries that probes are measured with, and the recall asked for.
MEASURE_ROWS, RECALL = 256, 0.95
METRICS = ("cosine", "ip", "l2")


def usable(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id, v of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    return rows.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    sizes = np.unique(np.asarray(column.value_lengths()))
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sizes.tolist()[:5]}")
    return np.asarray(column.flatten(), np.float64).reshape(len(column), int(sizes[0]))


def closeness(q: np.ndarray, m: np.ndarray, metric: str) -> np.ndarray:
    """Scores that rank downwards, to 12 digits; distances are negative."""
    if metric == "l2":
        # differences, not expanded squares: equal vectors are at distance zero whatever the batch; a few rows at a time
        s = np.concatenate([-np.sqrt(((q[lo : lo + 16, None, :] - m[None, :, :]) ** 2).sum(2)) for lo in range(0, len(q), 16)])
    else:
        s = q @ m.T
        if metric == "cosine":
            size = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(m, axis=1)[None]
            s = np.divide(s, size, out=np.zeros_like(s), where=size > 0)
    return np.round(s, 12)


def _solve(k: int, metric: str):
    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if queries.num_rows and data.num_rows:
            ids, own = (np.asarray(t.column(c).combine_chunks()) for t, c in ((queries, "query_id"), (data, "id")))
            q, m = matrix(queries.column("v")), matrix(data.column("v"))
            for lo in range(0, len(ids), 64):
                s, mine = closeness(q[lo : lo + 64], m, metric), ids[lo : lo + 64]
                for i in range(len(mine)):
                    at = np.flatnonzero(own != mine[i])
                    if len(at) > k:
                        at = at[s[i, at] >= np.partition(s[i, at], len(at) - k)[len(at) - k]]
                    best = at[np.lexsort((own[at], -s[i, at]))[:k]]
                    out.append((np.full(len(best), mine[i]), own[best], s[i, best]))
        query, found, score = map(np.concatenate, zip(*out, strict=True))
        return pa.table({"query_id": query, "id": found, "score": -score if metric == "l2" else score})

    return run


def _best(put: DataFrame, sent: DataFrame, keys: list[str], k: int, metric: str) -> DataFrame:
    """The best k of each query over all groups that it is in."""
    solved = put.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(_solve(k, metric), "query_id long, id long, score double")
    order = F.col("score").asc() if metric == "l2" else F.col("score").desc()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "id"))
    return solved.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def _every(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def _dealt(n: int | Column) -> Column:
    """A number under ``n`` for each row, however often ids repeat."""
    n = F.lit(n).cast("long") if isinstance(n, int) else n.cast("long")
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), n).cast("int")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank): exact nearest neighbours of each query among all vectors, its own id left out.

    ``metric`` cosine and ip rank by descending score, l2 by ascending distance;
    ties by id.
    """
    data, asked = usable(vectors, id_column, vector), usable(queries, id_column, vector)
    blocks, slices = (max(1, -(-t.count() // n)) for t, n in ((asked, QUERY_BLOCK), (data, SLICE_ROWS)))
    put = asked.select(F.col("id").alias("query_id"), "v", _dealt(blocks).alias("block")).withColumn("slice", _every(F.lit(slices)))
    sent = data.select("id", "v", _dealt(slices).alias("slice")).withColumn("block", _every(F.lit(blocks)))
    return _best(put, sent, ["block", "slice"], k, metric)


@dataclass
class Index:
    """``centres`` (rows: cells) and ``counts`` are in the driver; vectors are the table at ``path``/cells."""

    path: str
    metric: str
    centres: np.ndarray
    counts: np.ndarray

    @property
    def cells(self) -> int:
        return len(self.centres)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("id long, v array<double>, cell int").parquet(f"{self.path}/cells")


def cell_count(n: int, width: int) -> int:
    """Cells for ``n`` vectors of ``width`` components."""
    return max(1, min(max(MIN_CELLS, min(MAX_CELLS, int(2 * n**0.5))), CENTRE_BYTES // (8 * max(1, width)), max(1, n)))


def train(sample: np.ndarray, cells: int, seed: int, metric: str) -> np.ndarray:
    """Centres after ``ROUNDS`` of k-means; a cell that loses all its vectors takes the one farthest from its centre."""
    x = unit(sample) if metric == "cosine" else sample
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), min(cells, len(x)), replace=False))].copy()
    for _ in range(ROUNDS):
        far = np.empty(len(x))
        near = np.empty(len(x), np.int64)
        for lo in range(0, len(x), 4096):
            d = (centres**2).sum(1)[None] - 2 * x[lo : lo + 4096] @ centres.T
            near[lo : lo + 4096], far[lo : lo + 4096] = d.argmin(1), d.min(1) + (x[lo : lo + 4096] ** 2).sum(1)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
        lost = np.flatnonzero(count == 0)
        centres[lost] = x[np.argsort(-far, kind="stable")[: len(lost)]]
    return centres


def unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def order_of_cells(m: np.ndarray, centres: np.ndarray, metric: str) -> np.ndarray:
    """Cells of each row, closest first: by distance from the centre, for cosine of unit vectors; by inner product for ip."""
    m = unit(m) if metric == "cosine" else m
    own = 0 if metric == "ip" else (centres**2).sum(1)[None] / 2
    return np.argsort(own - m @ centres.T, axis=1, kind="stable")


def _with_cells(rows: DataFrame, centres: np.ndarray, metric: str, count: int, rank: bool = False) -> DataFrame:
    """id, v, cell (and its place in the order) for the ``count`` closest cells of each row."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for b in batches:
            m = matrix(b.column(1))
            # distances to every cell and copies of vectors: a few rows at a time, however many cells there are
            step = max(1, STEP_VALUES // (len(shared.value) + min(count, len(shared.value)) * m.shape[1] + 1))
            for lo in range(0, len(m), step):
                near = order_of_cells(m[lo : lo + step], shared.value, metric)[:, :count]
                n = near.shape[1]
                at = pa.array(np.repeat(np.arange(lo, lo + len(near)), n))
                out = [b.column(0).take(at), b.column(1).take(at), pa.array(near.ravel().astype(np.int32))]
                if rank:
                    out.append(pa.array(np.tile(np.arange(n, dtype=np.int32), len(near))))
                yield pa.RecordBatch.from_arrays(out, names=["id", "v", "cell", "place"][: len(out)])

    return rows.mapInArrow(run, "id long, v array<double>, cell int" + (", place int" if rank else ""))


def _drawn(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` rows by the order of their hashed ids."""
    return rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n)


def _write(rows: DataFrame, index: Index, mode: str) -> None:
    spark = rows.sparkSession
    each = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # by range, so that a large cell is several files and a small one shares a task
    rows.withColumn("deal", _dealt(1 << 20)).repartitionByRange(each, "cell", "deal").drop("deal").write.mode(mode).partitionBy("cell").parquet(f"{index.path}/cells")


def build(vectors: DataFrame, path: str, metric: str = "cosine", cells: int | None = None, seed: int = 7, id_column: str = "vec_id", vector: str = "embedding") -> Index:
    """Train, assign and write an index; every vector is in it, the sample only places the centres."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, vector)
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    cells = cells or cell_count(n, width or 0)
    sample = matrix(pa.array([r.v for r in _drawn(rows, min(TRAIN_ROWS, TRAIN_EACH * cells), seed).select("v").collect()], pa.list_(pa.float64())))
    index = Index(path, metric, train(sample, cells, seed, metric) if n else np.zeros((0, 0)), np.zeros(0, np.int64))
    if n:
        _write(_with_cells(rows, index.centres, "cosine" if metric == "cosine" else "l2", 1), index, "append")
        _count(spark, index)
    return index


def _count(spark: SparkSession, index: Index) -> None:
    """Count the cells (a row a cell) and write centres and counts."""
    index.counts = np.zeros(index.cells, np.int64)
    for r in index.table(spark).groupBy("cell").count().collect():
        index.counts[r["cell"]] = r["count"]
    told = [(i, c.tolist(), int(k)) for i, (c, k) in enumerate(zip(index.centres, index.counts, strict=True))]
    spark.createDataFrame(told, "cell int, centre array<double>, n long").coalesce(1).write.mode("overwrite").parquet(f"{index.path}/centres")
    spark.createDataFrame([(json.dumps({"metric": index.metric}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{index.path}/about")


def add(index: Index, vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> Index:
    """Append vectors to their cells; the centres stay."""
    _write(_with_cells(usable(vectors, id_column, vector), index.centres, "cosine" if index.metric == "cosine" else "l2", 1), index, "append")
    _count(vectors.sparkSession, index)
    return index


def load(spark: SparkSession, path: str) -> Index:
    """An index that was built before."""
    about = json.loads(spark.read.text(f"{path}/about").first().value)
    told = spark.read.schema("cell int, centre array<double>, n long").parquet(f"{path}/centres").orderBy("cell").collect()
    return Index(path, about["metric"], np.array([r.centre for r in told]), np.array([r.n for r in told]))


def search(index: Index, queries: DataFrame, k: int, probes: int, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank): the best k among the vectors of the ``probes`` cells closest to each query, its own id left out."""
    spark = queries.sparkSession
    if not index.counts.sum():
        return spark.createDataFrame([], "query_id long, id long, score double, rank int")
    probes = min(probes, index.cells)
    asked = cut(_with_cells(usable(queries, id_column, vector), index.centres, index.metric, probes))
    probed = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}  # a row a cell
    plan = [(c, max(1, -(-n // QUERY_BLOCK)), max(1, -(-int(index.counts[c]) // SLICE_ROWS))) for c, n in sorted(probed.items()) if index.counts[c]]
    if not plan:
        return spark.createDataFrame([], "query_id long, id long, score double, rank int")
    sizes = F.broadcast(spark.createDataFrame(plan, "cell int, blocks int, slices int"))
    cells = index.table(spark).filter(F.col("cell").isin([c for c, *_ in plan])).join(sizes, "cell")
    put = asked.join(sizes, "cell").select(F.col("id").alias("query_id"), "v", "cell", "slices", _dealt(F.col("blocks")).alias("block")).withColumn("slice", _every(F.col("slices")))
    sent = cells.select("id", "v", "cell", "blocks", _dealt(F.col("slices")).alias("slice")).withColumn("block", _every(F.col("blocks")))
    return _best(put.drop("slices"), sent.drop("blocks"), ["cell", "block", "slice"], k, index.metric)


def probes_for(index: Index, spark: SparkSession, k: int, recall: float = RECALL, seed: int = 11) -> int:
    """The fewest probes that reach ``recall`` of the exact k nearest, measured on ``MEASURE_ROWS`` of the index's own vectors."""
    if not index.counts.sum():
        return 1
    table = index.table(spark)
    some = cut(_drawn(table.select("id", "v"), MEASURE_ROWS, seed))
    true = nearest(table, some, k, index.metric, "id", "v").select(F.col("query_id").alias("q"), F.col("id"))
    place = _with_cells(some, index.centres, index.metric, index.cells, rank=True).select(F.col("id").alias("q"), "cell", "place")
    need = true.join(table.select("id", "cell"), "id").join(place, ["q", "cell"]).groupBy("place").count().orderBy("place").collect()  # a row a cell
    share = np.cumsum([r["count"] for r in need]) / max(1, sum(r["count"] for r in need))
    return int(need[int(np.argmax(share >= recall))].place) + 1 if need else 1


def recall_of(found: DataFrame, true: DataFrame) -> DataFrame:
    """query_id, hits, wanted: how many of each query's true neighbours were found."""
    hit = found.select("query_id", "id", F.lit(1).alias("hit"))
    return true.select("query_id", "id").join(hit, ["query_id", "id"], "left").groupBy("query_id").agg(F.count("hit").alias("hits"), F.count("*").alias("wanted"))
