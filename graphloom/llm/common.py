"""Helpers shared by the training-data operators.

* ``table`` reads one parquet table of a dataset folder through Spark only.
* ``cut`` writes a frame into the shared folder named by
  ``spark.checkpoint.dir`` and reads it back, which ends its lineage: a lost
  executor costs a re-read, never a recomputation of earlier stages. What is
  not released before is deleted when the driver ends.
* ``attach`` joins a side table to documents: broadcast when its counted size
  is within a fixed bound, a shuffled merge join beyond it.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Side tables up to this many bytes (measured, not estimated) may be broadcast.
BROADCAST_BYTES = 1 << 20
#: Sorts after every document id; stands for a missing one.
NO_ID = (1 << 63) - 1
#: Text bytes that one vectorised step works on.
CHUNK_BYTES = 2 << 20
#: What an Arrow batch holds; a longer row is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a session on one machine (tests) may do without the setting."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="graphloom-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends if not before."""
    path = f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    fs, where = _hadoop(spark, path)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def few(spark: SparkSession) -> int:
    """Partitions for a table of a few bytes per document: a twelfth of the shuffle partitions, so they grow with the input."""
    return max(2, -(-partitions(spark) // 12))


def cut(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """``df``, written to the shared folder and read back; in at most ``parts`` files where given.

    Small tables go in few files: every file costs its task several file system
    calls. They are computed by all tasks and then brought into few.
    """
    if parts is not None:
        df = df.repartition(parts)
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.mode("append").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._graphloom_path = path
    return back


def release(*frames: DataFrame) -> None:
    """Delete what ``cut`` wrote, once nothing reads it any more."""
    for df in frames:
        path = getattr(df, "_graphloom_path", None)
        if path:
            fs, where = _hadoop(df.sparkSession, path)
            fs.delete(where, True)


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds in a Python worker, in rows and in bytes: the same for all operators, as plans read it late."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def attach(docs: DataFrame, side: DataFrame, keys: list[str], how: str, side_bytes: int) -> DataFrame:
    """Join ``side`` (unique on ``keys``) to ``docs``; ``side_bytes`` is its measured size."""
    if side_bytes <= BROADCAST_BYTES:
        return docs.join(F.broadcast(side), keys, how)
    return docs.join(side.hint("merge"), keys, how)


def whole_rows(docs: DataFrame, *columns: str) -> DataFrame:
    """Those columns, as doc_id and text, and ``row``, a struct of all: no name of ``docs`` can clash with one that an operator adds."""
    named = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return docs.select(*(named(c).alias(n) for c, n in zip(columns, ("doc_id", "text"))), F.struct(*map(named, docs.columns)).alias("row"))


def tidy(run: Callable) -> Callable:
    """``run`` for mapInArrow, after which the worker gives unused memory back.

    Workers outlive their tasks; what their allocators keep would count against
    the executor while other stages run.
    """

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


def texts(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """UTF-8 bytes of every value; null is empty."""
    for x in column.cast(pa.large_binary()).to_pylist():
        yield x or b""


def chunks(sizes: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``limit`` bytes, one row at least."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def ranges_to_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(s, s + n)`` of every pair."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
