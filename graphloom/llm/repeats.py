"""Exact repeated passages by seed and extend, shared by the substring operators.

A text is a sequence of items (words or bytes). A window is ``window``
consecutive items of one document; the task is to find every window that also
occurs earlier. The windows that share a *seed* (the window's winnowed anchor:
its k-gram with the least hash, the rightmost of equals) are consecutive in a
document, and one such run with everything it covers is an *extent*. Equal
windows have equal anchors at equal offsets, so they can only lie in extents of
one anchor:

1. Map: every document's extents are found. Within a task, extents that are
   equal (anchor, extent hash: 128 bits) collapse: all but the first are known
   repeats. The rest go, packed by hash of their anchor, to buckets; a passage
   in a third of all documents costs one entry per task, not per document.
2. Bucket: equal extents collapse once more. Where one anchor has different
   extents that agree on the left or on the right of it (half of the window's
   rest, as any shared window must), those left are asked for in full. A bucket
   of over ``BUCKET_EXTENTS`` extents (a seed in very many surroundings) is not held: its
   extents collapse piece by piece and what is left is all asked for.
3. Refine: the extents asked for are cut from their documents and brought
   together by anchor, where the caller's ``in_block`` compares them: by extending
   the seed both ways, or by suffix array. The contexts of an anchor that exceed a
   block are split by the hashes of their windows instead; both ways are exact.

Repeated windows are unions of whole items: overlapping and adjacent ones merge
into maximal repeats. Documents and repeats are joined by id, broadcast only
when the measured size of the repeats allows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from graphloom.llm.common import CHUNK_BYTES, NO_ID, attach, chunks, cut, mix, partitions, ranges_to_index, small_batches, texts, tidy

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Low bits of a packed k-gram hash that hold its position.
PLACE_BITS = 28
#: Extents that a task holds before it collapses and sends them.
FLUSH = 1 << 18
#: Extents of one bucket that a task holds.
BUCKET_EXTENTS = 1 << 20
#: Contexts of one anchor, in items, up to which they are refined as one block; small anchors share blocks of about GROUP.
BLOCK, GROUP = 1 << 16, 1 << 11

ROWS_SCHEMA = "kind int, bucket int, id long, dk long, blob binary"
FOUND_SCHEMA = "kind int, id long, dk long, block long, blob binary"


@dataclass(frozen=True)
class Spec:
    """How to read texts and what counts as a repeat."""

    window: int
    k: int
    #: Values (uint64) of a text's items; equal items have equal values.
    values: Callable[[bytes], np.ndarray]
    #: True: an earlier start in the same document counts; false: only smaller ids do.
    within: bool
    #: The contexts at (first item, items) pairs of a text.
    cut_out: Callable[[bytes, list[tuple[int, int]]], list[bytes]]
    #: Repeats, as rows of FOUND_SCHEMA, among contexts (id, dk, place, windows, context).
    in_block: Callable[[list[tuple]], list[tuple]]

    @property
    def side(self) -> int:
        """Items that a shared window must have on one side of its anchor."""
        return (self.window - self.k + 1) // 2


class Powers:
    """Powers of the polynomial hash's base and its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, U)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, U)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


POWERS = Powers()


class Sums:
    """Hashes of any run of items, from running sums."""

    def __init__(self, values: np.ndarray):
        up, self.down = POWERS(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def all(self, length: int) -> np.ndarray:
        return (self.sums[length:] - self.sums[:-length]) * self.down[: len(self.sums) - length]


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` hashes, the position of the least, the rightmost of equals.

    Positions are packed into PLACE_BITS bits, so longer texts go in overlapping parts.
    """
    size, runs = 1 << PLACE_BITS, len(hashes) - width + 1
    if len(hashes) > size:
        step = size - width + 1
        return np.concatenate([winnow(hashes[lo : lo + size], width) + lo for lo in range(0, runs, step)])
    mask = U(size - 1)
    packed = (hashes & ~mask) | (mask - np.arange(len(hashes), dtype=U))
    step, least = 1, packed
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < width:
        least = np.minimum(least[:runs], least[width - step :])
    return (mask - (least & mask)).astype(np.int64)


#: Columns of an extent: anchor, extent hash, id, dk, first window's place, windows, anchor's offset, left and right checks.
FIELDS = (("anchor", "<u8"), ("extent", "<u8"), ("id", "<i8"), ("dk", "<i8"), ("place", "<i4"), ("n", "<u2"), ("left", "<u2"), ("right", "<u2"))
Extents = dict[str, np.ndarray]


def extents(values: list[np.ndarray], ids: np.ndarray, dks: np.ndarray, spec: Spec) -> Extents | None:
    """All extents of some documents."""
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    long = np.flatnonzero(sizes >= spec.window)
    if not len(long):
        return None
    sizes, ids, dks = sizes[long], ids[long], dks[long]
    joined = np.concatenate([values[i] for i in long])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    sums = Sums(joined)
    grams = mix(sums.all(spec.k))
    anchor = winnow(grams, spec.window - spec.k + 1)
    first = ranges_to_index(starts, sizes - spec.window + 1)  # every window of one document
    anchor = anchor[first]
    new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    n = np.diff(np.append(new, len(first)))
    first, anchor = first[new], anchor[new]
    doc = np.searchsorted(ends, first, "right")
    shape = n.astype(U) * U(0xD6E8FEB86659FD93) + (anchor - first).astype(U) * U(0xA0761D6478BD642F)
    side, after = spec.side, anchor + spec.k
    left = mix(sums.runs(np.maximum(anchor - side, 0), anchor)) & U(0xFFFF) | U(1)
    right = mix(sums.runs(np.minimum(after, len(joined)), np.minimum(after + side, len(joined)))) & U(0xFFFF) | U(1)
    return {
        "anchor": grams[anchor],
        "extent": mix(sums.runs(first, first + n + spec.window - 1) + shape),
        "id": ids[doc],
        "dk": dks[doc],
        "place": (first - starts[doc]).astype(np.int32),
        "n": n.astype(np.uint16),
        "left": np.where(anchor - side >= starts[doc], left, U(0)).astype(np.uint16),
        "right": np.where(after + side <= ends[doc], right, U(0)).astype(np.uint16),
    }


def windows(values: np.ndarray, i: int, dk: int, start: np.ndarray, n: np.ndarray, spec: Spec) -> Extents:
    """The windows in some ranges of one document, each as an extent of its own."""
    at = np.unique(ranges_to_index(start.astype(np.int64), n.astype(np.int64)))
    sums, again = Sums(values), Sums(mix(values))
    ends = at + spec.window
    zeros = np.zeros(len(at), np.uint16)
    return {
        "anchor": mix(sums.runs(at, ends)), "extent": mix(again.runs(at, ends)), "id": np.full(len(at), i), "dk": np.full(len(at), dk),
        "place": at.astype(np.int32), "n": zeros + np.uint16(1), "left": zeros, "right": zeros,
    }


def join_extents(parts: list[Extents]) -> Extents:
    return {f: np.concatenate([p[f] for p in parts]) for f, _ in FIELDS}


def collapse(x: Extents, within: bool) -> tuple[Extents, np.ndarray]:
    """Sorted extents, and which of them have an equal one that is earlier."""
    order = np.lexsort((x["place"], x["id"], x["extent"], x["anchor"]))
    x = {f: c[order] for f, c in x.items()}
    new = np.concatenate([[True], (x["anchor"][1:] != x["anchor"][:-1]) | (x["extent"][1:] != x["extent"][:-1])])
    heads = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = x["id"] > x["id"][heads]
    if within:
        later |= (x["id"] == x["id"][heads]) & (x["place"] > x["place"][heads])
    return x, later


def pack_extents(x: Extents) -> bytes:
    """Column by column, the bytes of equal weight together: what compresses well."""
    n = len(x["anchor"])
    planes = [np.ascontiguousarray(x[f].astype(t)).view(np.uint8).reshape(n, -1).T.tobytes() for f, t in FIELDS]
    return n.to_bytes(4, "little") + pa.compress(b"".join(planes), "zstd", asbytes=True)


def unpack_extents(blob: bytes) -> Extents:
    n = int.from_bytes(blob[:4], "little")
    width = sum(np.dtype(t).itemsize for _, t in FIELDS)
    raw, at, out = pa.decompress(blob[4:], n * width, "zstd", asbytes=True), 0, {}
    for f, t in FIELDS:
        w = np.dtype(t).itemsize
        out[f] = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * w, at).reshape(w, n).T).view(t).ravel()
        at += n * w
    return out


def pack_pairs(a: np.ndarray, b: np.ndarray) -> bytes:
    return np.stack([a, b], 1).astype("<i4").tobytes()


def unpack_pairs(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<i4").reshape(-1, 2).astype(np.int64)


def by_document(x: Extents, which: np.ndarray, length: Callable[[Extents], np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    """(id, dk, packed (place, length) pairs) of the chosen extents, a document at a time."""
    order = np.flatnonzero(which)
    order = order[np.lexsort((x["place"][order], x["dk"][order], x["id"][order]))]
    i, dk, place, size = x["id"][order], x["dk"][order], x["place"][order], length(x)[order]
    cuts = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (dk[1:] != dk[:-1])])) if len(i) else []
    for a, b in zip(cuts, [*cuts[1:], len(i)]):
        yield int(i[a]), int(dk[a]), pack_pairs(place[a:b], size[a:b])


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields)], [f for f, _ in fields])


def send(x: Extents, spec: Spec, buckets: int) -> pa.RecordBatch:
    """What a task says of its extents: repeats it knows of (kind 0), and the rest by bucket (kind 1)."""
    x, later = collapse(x, spec.within)
    covered = lambda y: y["n"].astype(np.int64) + spec.window - 1
    rows = [(0, i % buckets, i, dk, blob) for i, dk, blob in by_document(x, later, covered)]
    kept = {f: c[~later] for f, c in x.items()}
    bucket = (kept["anchor"] % U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in range(buckets):
        if edges[b] < edges[b + 1]:
            part = order[edges[b] : edges[b + 1]]
            rows.append((1, b, None, None, pack_extents({f: c[part] for f, c in kept.items()})))
    return _batch(rows, ROWS_SCHEMA)


def ask(x: Extents, spec: Spec) -> np.ndarray:
    """Which collapsed extents may share a window with a different extent of their anchor."""
    out = np.zeros(len(x["anchor"]), bool)
    for side in ("left", "right"):
        order = np.lexsort((x["extent"], x[side], x["anchor"]))
        a, s, e = x["anchor"][order], x[side][order], x["extent"][order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (s[1:] != s[:-1])])
        group = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(a)) - 1
        many = (e[heads] != e[tails]) & (s[heads] != 0)
        out[order] |= many[group]
    return out


def blocks_of(x: Extents, which: np.ndarray, spec: Spec, bucket: int, most: int) -> np.ndarray:
    """Block numbers for the extents asked for: whole anchors, some to a block; -1 where one has over ``most`` items."""
    at = np.flatnonzero(which)
    anchor, size = x["anchor"][at], x["n"][at].astype(np.int64) + spec.window
    new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    group = np.cumsum(new) - 1
    total = np.bincount(group, weights=size).astype(np.int64)
    number = np.cumsum(np.where(total > most, 0, total)) // GROUP
    return np.where(total > most, -1, (bucket << 32) + number)[group]


def resolve(rows: DataFrame, spec: Spec, buckets: int, refine: bool) -> DataFrame:
    """Buckets to repeats (kind 0) and, if ``refine``, extents to compare in full (kind 1)."""
    small_batches(rows.sparkSession)
    covered = lambda y: y["n"].astype(np.int64) + spec.window - 1
    limit, most = BUCKET_EXTENTS, BLOCK

    def finish(bucket: int, parts: list[bytes], over: bool) -> list[tuple]:
        """``over``: these are not all extents of the bucket, so all that do not collapse are asked for."""
        x, later = collapse(join_extents([unpack_extents(p) for p in parts]), spec.within)
        out = [(0, i, dk, -1, blob) for i, dk, blob in by_document(x, later, covered)]
        if refine:
            x = {f: c[~later] for f, c in x.items()}
            which = np.ones(len(x["anchor"]), bool) if over else ask(x, spec)
            if which.any():
                block = np.full(len(which), -1)
                if not over:
                    block[which] = blocks_of(x, which, spec, bucket, most)
                for b in np.unique(block[which]).tolist():
                    out += [(1, i, dk, b, blob) for i, dk, blob in by_document(x, which & (block == b), lambda y: y["n"].astype(np.int64))]
        return out

    def run(batches):
        bucket, parts, held, over = None, [], 0, False
        for batch in batches:
            out = []
            for kind, b, i, dk, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    out.append((0, i, dk, -1, blob))
                    continue
                if b != bucket:
                    if parts:
                        out += finish(bucket, parts, over)
                    bucket, parts, held, over = b, [], 0, False
                n = int.from_bytes(blob[:4], "little")
                if refine and parts and held + n > limit:
                    out += finish(bucket, parts, True)
                    parts, held, over = [], 0, True
                parts.append(blob)
                held += n
            yield _batch(out, FOUND_SCHEMA)
        if parts:
            yield _batch(finish(bucket, parts, over), FOUND_SCHEMA)

    return rows.repartition(partitions(rows.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(run), FOUND_SCHEMA)


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` with ``__id`` (a missing id sorts last) and ``__dk``, which tells rows of one id apart."""
    ids = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("i"))
    once = ids.groupBy("i").count().filter("count > 1").isEmpty()
    return docs.withColumns({"__id": F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)), "__dk": F.lit(0).cast("long") if once else F.xxhash64(text)})


def _gather(found: DataFrame) -> tuple[DataFrame, int]:
    size = found.agg(F.sum(F.octet_length("blob") + 48)).first()[0] or 0
    return found.groupBy(F.col("id").alias("__id"), F.col("dk").alias("__dk")).agg(F.collect_set("blob").alias("__blobs")), size


def _refine_by_hash(asked: DataFrame, docs: DataFrame, text: str, spec: Spec, buckets: int) -> DataFrame:
    side, size = _gather(asked)
    joined = attach(docs.select("__id", "__dk", F.col(text).alias("text")), side, ["__id", "__dk"], "inner", size)

    def run(batches):
        parts, held = [], 0
        for b in batches:
            for i, dk, t, blobs in zip(b.column("__id").to_pylist(), b.column("__dk").to_pylist(), texts(b.column("text")), b.column("__blobs").to_pylist()):
                pairs = unpack_pairs(blobs)
                parts.append(windows(spec.values(t), i, dk, pairs[:, 0], pairs[:, 1], spec))
                held += len(parts[-1]["anchor"])
                if held > FLUSH:
                    yield send(join_extents(parts), spec, buckets)
                    parts, held = [], 0
        if parts:
            yield send(join_extents(parts), spec, buckets)

    return resolve(joined.mapInArrow(tidy(run), ROWS_SCHEMA), spec, buckets, refine=False)


def _refine_in_blocks(asked: DataFrame, docs: DataFrame, text: str, spec: Spec) -> DataFrame:
    """Contexts of each block, cut from their documents and brought together; ``spec.in_block`` decides."""
    packed = asked.withColumn("blob", F.concat(F.expr("unhex(lpad(hex(block), 16, '0'))"), "blob"))
    side, size = _gather(packed)
    joined = attach(docs.select("__id", "__dk", F.col(text).alias("text")), side, ["__id", "__dk"], "inner", size)
    contexts = "block long, id long, dk long, place int, n int, context binary"

    def cut_out(batches):
        for b in batches:
            rows = []
            for i, dk, t, blobs in zip(b.column("__id").to_pylist(), b.column("__dk").to_pylist(), texts(b.column("text")), b.column("__blobs").to_pylist()):
                pairs = [(int.from_bytes(blob[:8], "big"), p, n) for blob in blobs for p, n in unpack_pairs([blob[8:]]).tolist()]
                found = spec.cut_out(t, [(p, n + spec.window - 1) for _, p, n in pairs])
                rows += [(block, i, dk, p, n, context) for (block, p, n), context in zip(pairs, found)]
            yield _batch(rows, contexts)

    def run(batches):
        block, held = None, []
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0] != block:
                    if held:
                        out += spec.in_block(held)
                    block, held = row[0], []
                held.append(row[1:])
            yield _batch(out, FOUND_SCHEMA)
        if held:
            yield _batch(spec.in_block(held), FOUND_SCHEMA)

    moved = joined.mapInArrow(tidy(cut_out), contexts).repartition(partitions(docs.sparkSession), "block").sortWithinPartitions("block", "id", "place")
    return moved.mapInArrow(tidy(run), FOUND_SCHEMA)


def merged(i: np.ndarray, dk: np.ndarray, at: np.ndarray, window: int) -> list[tuple]:
    """Window starts as maximal repeats of each document."""
    if not len(i):
        return []
    sort = np.lexsort((at, dk, i))
    i, dk, at = i[sort], dk[sort], at[sort]
    doc = np.concatenate([[True], (i[1:] != i[:-1]) | (dk[1:] != dk[:-1])])
    new = np.flatnonzero(doc | np.concatenate([[True], at[1:] > at[:-1] + 1]))
    length = at[np.append(new[1:], len(at)) - 1] - at[new] + window
    cuts = np.flatnonzero(doc[new])
    return [(0, int(i[new[a]]), int(dk[new[a]]), -1, pack_pairs(at[new[a:b]], length[a:b])) for a, b in zip(cuts, [*cuts[1:], len(new)])]


def find_repeats(docs: DataFrame, text: str, spec: Spec) -> DataFrame:
    """(id, dk, blob): (place, items) pairs of every repeat; ``docs`` comes from ``keyed``."""
    spark = docs.sparkSession
    small_batches(spark)
    buckets = 4 * partitions(spark)

    def run(batches):
        parts, held = [], 0
        for b in batches:
            data = list(texts(b.column("text")))
            ids, dks = (b.column(c).to_numpy(zero_copy_only=False) for c in ("__id", "__dk"))
            for lo, hi in chunks(np.fromiter(map(len, data), np.int64, len(data)), CHUNK_BYTES // 4):
                x = extents([spec.values(t) for t in data[lo:hi]], ids[lo:hi], dks[lo:hi], spec)
                if x:
                    parts.append(x)
                    held += len(x["anchor"])
                if held > FLUSH:
                    yield send(join_extents(parts), spec, buckets)
                    parts, held = [], 0
        if parts:
            yield send(join_extents(parts), spec, buckets)

    rows = docs.select("__id", "__dk", F.col(text).alias("text")).mapInArrow(tidy(run), ROWS_SCHEMA)
    parts = max(4, -(-partitions(spark) // 4))
    found = cut(resolve(rows, spec, buckets, refine=True), "repeats", parts)
    asked = found.filter("kind = 1")
    pieces = [found.filter("kind = 0")]
    hashed = asked.filter("block = -1")
    if not hashed.isEmpty():
        pieces.append(cut(_refine_by_hash(hashed, docs, text, spec, buckets), "refined", parts))
    blocked = asked.filter("block <> -1")
    if not blocked.isEmpty():
        pieces.append(cut(_refine_in_blocks(blocked, docs, text, spec), "sorted", parts))
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    return out.select("id", "dk", "blob")


def with_repeats(docs: DataFrame, text: str, spec: Spec) -> DataFrame:
    """``docs`` (from ``keyed``) with ``__blobs``: the repeats of each row, null where it has none."""
    side, size = _gather(find_repeats(docs, text, spec))
    small_batches(docs.sparkSession)
    return attach(docs, side, ["__id", "__dk"], "left", size)


def covered(blobs: list[bytes] | None, n: int) -> np.ndarray:
    """Which of ``n`` items repeats cover."""
    if not blobs:
        return np.zeros(n, bool)
    pairs = unpack_pairs(blobs)
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, pairs[:, 0], 1)
    np.add.at(depth, pairs.sum(1), -1)
    return np.cumsum(depth[:-1]) > 0


def same_columns(docs: DataFrame, *more: StructField) -> StructType:
    return StructType([*docs.schema.fields, *more])


__all__ = ["LongType", "Spec", "covered", "find_repeats", "keyed", "same_columns", "with_repeats"]
