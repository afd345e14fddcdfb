"""SimHash near-duplicates, found through Golay-code fuzzy hashing.

A fingerprint has 64 bits: bit b is set if it is set in over half of the XXH64
values of the text's word shingles. Two fingerprints that differ in at most two
bits link; components of links are groups of near-duplicates.

Finding links without comparing all pairs: a fingerprint is cut into three
segments of 22, 21 and 21 bits. Two errors cannot touch all three segments, so
one agrees exactly (pigeonhole); the next segment, read as a 23-bit word of the
perfect [23,12,7] Golay code, is decoded to the codewords within distance four:
one codeword, or six where the nearest is at distance three. Words within two
bits of each other always share one of these. So each fingerprint gets 3 to 18
keys (segment number, exact segment, codeword index), and every linked pair
meets under one of them, where the distance is verified.

Equal fingerprints are collapsed before that. Buckets over ``BUCKET``
fingerprints are keyed again with the third segment's codewords; those still
over it are resolved by looking up each fingerprint's neighbours of up to two
flipped bits, which is linear in the bucket. Within a bucket only a spanning
forest of links is emitted, never all pairs.

Defined results: null or wordless texts have fingerprint zero and link like any
other; texts of one or two words are one shingle; a null id sorts after all
others; repeated rows each get a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import BROADCAST_BYTES, NO_ID, cut, few, small_batches, texts, tidy
from graphloom.llm.components import components

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: Fingerprints in a bucket that are compared with each other directly.
BUCKET = 1024
#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the Golay code.
GENERATOR = 0b101011100011
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, (ends - 1)[shingle - 1 :].tolist())], np.uint64)
    lanes = h.view(np.uint8).reshape(-1, 8).astype(np.int64) + 256 * np.arange(8)
    ones = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(2 * ones.ravel() > len(h), bitorder="little").tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _syndrome(word: int) -> int:
    for b in range(22, 10, -1):
        if word >> b & 1:
            word ^= GENERATOR << (b - 11)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits, and per syndrome the error words that lead to near codewords."""
    low = np.array([_syndrome(x) for x in range(1 << 12)])
    high = np.array([_syndrome(x << 12) for x in range(1 << 11)])
    one = [_syndrome(1 << b) for b in range(23)]
    near = np.zeros((2048, 6), np.int64)
    by: dict[int, list[int]] = {0: [0]}
    for a in range(23):
        by[one[a]] = [1 << a]
        for b in range(a):
            by[one[a] ^ one[b]] = [1 << a | 1 << b]
            for c in range(b):
                by.setdefault(one[a] ^ one[b] ^ one[c], []).append(1 << a | 1 << b | 1 << c)
    for a in range(23):
        for b in range(a):
            for c in range(b):
                for d in range(c):
                    if by[s := one[a] ^ one[b] ^ one[c] ^ one[d]][0].bit_count() == 3:
                        by[s].append(1 << a | 1 << b | 1 << c | 1 << d)
    for s, words in by.items():
        near[s] = (words * 6)[:6]
    return low, high, near


_LOW, _HIGH, _NEAR = _tables()


def codewords(word: np.ndarray) -> np.ndarray:
    """(n, 6) codeword indices within distance four of each 23-bit word; the first repeats where there is one."""
    error = _NEAR[_LOW[word & 0xFFF] ^ _HIGH[word >> 12]]
    return (word[:, None] ^ error) >> 11


def segment(fp: np.ndarray, k: int) -> np.ndarray:
    start, width = SEGMENTS[k]
    return ((fp >> np.uint64(start)) & np.uint64((1 << width) - 1)).astype(np.int64)


def golay_keys(fp: np.ndarray, exact: int) -> np.ndarray:
    """(n, 6) keys of segment ``exact`` and the codewords of the next one."""
    head = (segment(fp, exact) << 12) | (exact << 34)
    return head[:, None] | codewords(segment(fp, (exact + 1) % 3))


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links of a bucket: each member but the first of every local component, with that first."""
    n = len(fps)
    label = np.arange(n)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= DISTANCE
    while True:
        new = np.where(near, label[None, :], n).min(1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(i, int(r)) for i, r in enumerate(label) if r != i]


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, dk (a hash of the text) and fp (the fingerprint as a signed long) of every row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = pa.array([_signed(fingerprint(t)) for t in texts(b.column("text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("dk"), fp], ["doc_id", "dk", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("dk"), F.col(text).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, dk long, fp long")


def _keyed(nodes: DataFrame, deeper: bool = False) -> DataFrame:
    """(key, sub, fp): all keys of every fingerprint; ``sub`` is a codeword of the third segment where asked for."""

    def run(batches):
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for exact in range(3):
                keys = golay_keys(fp, exact)
                if deeper:  # only of the key that is too large
                    mine = (keys == b.column("key").to_numpy(zero_copy_only=False)[:, None]).any(1)
                    third = codewords(segment(fp, (exact + 2) % 3))[mine]
                    keys = np.repeat(b.column("key").to_numpy(zero_copy_only=False)[mine], 6)
                    rows = np.stack([keys, third.ravel(), np.repeat(fp[mine], 6).view(np.int64)], 1)
                else:
                    rows = np.stack([keys.ravel(), np.full(keys.size, -1), np.repeat(fp, 6).view(np.int64)], 1)
                again = np.zeros(len(rows), bool)
                six = rows[:, 1 if deeper else 0].reshape(-1, 6)
                for k in range(1, 6):
                    again[k::6] = six[:, k] == six[:, 0]
                rows = rows[~again]
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, k]) for k in range(3)], ["key", "sub", "fp"])

    return nodes.mapInArrow(tidy(run), "key long, sub long, fp long")


def _local_links(buckets: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            a, c = [], []
            for group in b.column("fps"):
                fps = np.unique(np.array(group.as_py(), np.int64)).view(np.uint64)
                for i, r in forest(fps):
                    a.append(_signed(int(fps[i])))
                    c.append(_signed(int(fps[r])))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    return buckets.select("fps").mapInArrow(tidy(run), "a long, b long")


def _flipped(keyed: DataFrame) -> DataFrame:
    """(fp, other): every fingerprint with all its neighbours of one or two flipped bits outside the exact segment."""

    def run(batches):
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False)
            exact = b.column("key").to_numpy(zero_copy_only=False) >> 34
            for k in range(3):
                start, width = SEGMENTS[k]
                free = [1 << i for i in range(64) if not start <= i < start + width]
                masks = np.array(free + [x | y for j, x in enumerate(free) for y in free[:j]], np.uint64).view(np.int64)
                mine = fp[exact == k]
                for lo in range(0, len(mine), 256):
                    part = mine[lo : lo + 256]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, len(masks))), pa.array((part[:, None] ^ masks).ravel())], ["fp", "other"])

    return keyed.mapInArrow(tidy(run), "fp long, other long")


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): links that span the near-duplicate graph of distinct fingerprints ``nodes(fp)``."""
    parts = few(nodes.sparkSession)
    keyed = _keyed(nodes.select("fp"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut(keyed.join(sizes, "key"), "golay-shared", parts)
    found = _local_links(shared.filter(F.col("n") <= BUCKET).groupBy("key").agg(F.collect_list("fp").alias("fps")))
    large = shared.filter(F.col("n") > BUCKET)
    if not large.isEmpty():
        deeper = cut(_keyed(large.select("key", "fp"), deeper=True), "golay-deeper", parts)
        sizes = deeper.groupBy("key", "sub").agg(F.count("*").alias("n")).filter("n > 1")
        split = deeper.join(sizes, ["key", "sub"])
        found = found.unionByName(_local_links(split.filter(F.col("n") <= BUCKET).groupBy("key", "sub").agg(F.collect_list("fp").alias("fps"))))
        rest = split.filter(F.col("n") > BUCKET).select("key", "fp").distinct()
        flips = _flipped(rest).join(nodes.select(F.col("fp").alias("other")), "other")
        found = found.unionByName(flips.select(F.col("fp").alias("a"), F.col("other").alias("b")))
    return found.distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, dk, fp, component_id (null ids count as the largest id) and keeper, the (doc_id, fp, dk) of the document that stays."""
    parts = few(docs.sparkSession)
    found = fingerprints(docs, doc_id, text).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    rows = cut(found, "fingerprints", parts)
    nodes = cut(rows.groupBy("fp").agg(F.min(F.struct("doc_id", "fp", "dk")).alias("first")), "nodes", parts)
    roots = components(links(nodes), "a", "b")
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("keeper"))
    mapped = placed.join(least, "root").select("fp", F.col("keeper.doc_id").alias("component_id"), "keeper")
    return rows.join(mapped, "fp").select("doc_id", "dk", "fp", "component_id", "keeper")


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    return near_duplicates(docs, doc_id, text).select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("component_id") != NO_ID, F.col("component_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each near-duplicate group, the one with the smallest id; all columns kept, whatever their names.

    Rows are told apart by their id and a hash of their text, so the texts are
    fingerprinted once. Of rows that repeat both, any one stays.
    """
    groups = cut(near_duplicates(docs, doc_id, text), "groups", few(docs.sparkSession))
    mine = F.struct("doc_id", "fp", "dk")
    gone = groups.filter(mine != F.col("keeper")).select("doc_id", "dk").distinct()
    again = not groups.groupBy("doc_id", "dk").count().filter("count > 1").isEmpty()
    small = gone.count() * 16 <= BROADCAST_BYTES
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))  # one column, so that no name can clash
    marked = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("dk"), row.alias("row"))
    kept = marked.join(F.broadcast(gone) if small else gone.hint("merge"), ["doc_id", "dk"], "left_anti")
    if again:
        kept = kept.dropDuplicates(["doc_id", "dk"])
    return kept.select("row.*")
