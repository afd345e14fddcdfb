"""Token ids in Arrow stream files of fixed-size lists.

A file is an Arrow IPC stream whose batches hold equal-length sequences:
``input_ids`` (fixed-size list of uint16, or uint32 for vocabularies over 65,536)
and ``mask`` (fixed-size list of bool; false pads the file's last sequence). A
reader maps the file into memory; every sequence, mask or run of ids inside a
batch is a view of it, found by arithmetic alone.

Writing: documents are range-partitioned and sorted by id, so files follow each
other in id order; each task encodes its range and streams it to one file in the
shared folder. Where each document lies goes into an index table, written with
Spark's commit protocol: files of failed or repeated attempts are never named
there. A document's global start is its file's base plus its place in the file;
bases come from one total per file.

Defined results: a null text is empty and has only the end id; null ids come
after all others, by a hash of their text; rows that share an id are ordered by text; repeated rows are
written once each; an empty table writes nothing.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import NO_ID, attach, chunks, cut, partitions, scratch, small_batches, texts, tidy
from graphloom.llm.tokens import TOKENIZER, encoder, with_end

LENGTH, ROWS, END = 2048, 64, 1
#: Files whose totals are summed up together.
BLOCK_PARTS = 1024
INDEX_SCHEMA = "doc_id long, part int, file string, place long, n_tokens long"


class Writer:
    """Streams ids into one file of fixed-size lists."""

    def __init__(self, uri: str, wide: bool, length: int = LENGTH, rows: int = ROWS):
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(uri)
        where.create_dir(path.rpartition("/")[0], recursive=True)
        self.kind = pa.uint32() if wide else pa.uint16()
        self.length, self.rows = length, rows
        self.schema = pa.schema([("input_ids", pa.list_(self.kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = where.open_output_stream(path)
        self.stream = pa.ipc.new_stream(self.out, self.schema)
        self.parts: list[np.ndarray] = []
        self.held = self.total = 0

    def _write(self, ids: np.ndarray) -> None:
        real = len(ids)
        ids = np.pad(ids, (0, -real % self.length))
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(ids.astype("<u4" if self.kind == pa.uint32() else "<u2")), self.length),
            pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(ids)) < real), self.length),
        ]
        self.stream.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def append(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        block = self.length * self.rows
        if self.held >= block:
            ids = np.concatenate(self.parts)
            whole = len(ids) // block * block
            for lo in range(0, whole, block):
                self._write(ids[lo : lo + block])
            self.parts, self.held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        if self.held:
            self._write(np.concatenate(self.parts))
        self.stream.close()
        self.out.close()


class Reader:
    """Random access to a file: sequences, masks and runs of ids."""

    def __init__(self, uri: str, rows: int = ROWS):
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(uri)
        local = isinstance(where, fs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else where.open_input_stream(path)
        batches = list(pa.ipc.open_stream(self.source))
        self.length = batches[0].column(0).type.list_size
        self.block = self.length * rows
        self.ids = [b.column(0).values.to_numpy() for b in batches]
        self.masks = [b.column(1).values for b in batches]

    def run(self, place: int, n: int) -> np.ndarray:
        """``n`` ids from ``place`` on; a view where they lie in one batch."""
        b, at = divmod(place, self.block)
        if at + n <= self.block:
            return self.ids[b][at : at + n]
        parts = []
        while n:
            got = self.ids[b][at : at + n]
            parts.append(got)
            n, b, at = n - len(got), b + 1, 0
        return np.concatenate(parts)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        b, at = divmod(i * self.length, self.block)
        return self.ids[b][at : at + self.length], self.masks[b].slice(at, self.length)


def write_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, end: int = END, length: int = LENGTH, folder: str | None = None) -> DataFrame:
    """Write the files into ``folder`` (without one: the shared folder, until the driver ends); returns their index (doc_id, part, file, place, n_tokens)."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or scratch(spark, "tokens")
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text).alias("text"))
    # rows without an id are dealt out and ordered by a hash of their text
    ordered = rows.withColumn("tie", F.when(F.col("doc_id") == NO_ID, F.xxhash64("text")).otherwise(F.lit(0))).repartitionByRange(partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")

    def run(batches):
        part, writer = TaskContext.get().partitionId(), None
        encode = encoder(tokenizer)
        for b in batches:
            data = list(texts(b.column("text")))
            ids = b.column("doc_id").to_pylist()
            for lo, hi in chunks(np.fromiter(map(len, data), np.int64, len(data))):
                if writer is None:
                    file = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.arrows"
                    writer = Writer(file, encode.wide, length)
                flat, sizes = with_end(*encode(data[lo:hi]), end)
                places = writer.total + np.cumsum(sizes) - sizes
                writer.append(flat)
                n = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo:hi], pa.int64()), pa.array([part] * n, pa.int32()), pa.array([file] * n), pa.array(places), pa.array(sizes)],
                    ["doc_id", "part", "file", "place", "n_tokens"],
                )
        if writer is not None:
            writer.close()

    return cut(ordered.mapInArrow(tidy(run), INDEX_SCHEMA), "token-index")


def read_tokens(index: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    totals = cut(index.groupBy("part", "file").agg(F.sum("n_tokens").alias("n")).withColumn("block", F.floor(F.col("part") / BLOCK_PARTS)), "totals", 1)
    # running sums in blocks of files, then of blocks: one row for BLOCK_PARTS files comes to the driver
    blocks = totals.groupBy("block").agg(F.sum("n").alias("n")).orderBy("block").collect()
    sums, bases = 0, []
    for r in blocks:
        bases.append((r.block, sums))
        sums += r.n
    before = F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    block_bases = index.sparkSession.createDataFrame(bases, "block long, block_base long")
    files = totals.withColumn("inside", before).join(F.broadcast(block_bases), "block").select("part", "file", (F.col("inside") + F.col("block_base")).alias("base"))
    size = totals.count() * 200
    based = attach(index, files, ["part", "file"], "inner", size)

    def run(batches):
        file = reader = None
        for b in batches:
            out = []
            for i, f, place, n, base in zip(*(b.column(c).to_pylist() for c in ("doc_id", "file", "place", "n_tokens", "base"))):
                if f != file:
                    file, reader = f, Reader(f)
                out.append((None if i == NO_ID else i, base + place, n, zlib.crc32(reader.run(place, n).astype("<u4").tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 4, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return based.mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    return read_tokens(write_tokens(docs, doc_id, text, tokenizer))
