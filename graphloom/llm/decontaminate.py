"""Benchmark decontamination by a document-partitioned positional inverted index.

Training documents are dealt into shards as they are scanned. Every shard keeps
a positional posting list for each of its terms (``build_index`` stores them as a
table; nothing is shuffled). The test set is read in blocks of bounded size. One
block at a time is broadcast and searched for in every shard, its hits are written, and its
broadcast is given back before the next, so neither the driver nor a worker ever
holds more than one block, however large the test set is.

A search starts with the postings of each window's rarest term in the
shard, shifts them by the term's offset, and intersects them with the shifted
postings of the next rarest terms until only whole windows are left.

``slop`` gives proximity matches: the words of a window in order, with at most so
many other words between two that follow each other. From each posting of the
rarest term, all positions that such chains reach are followed to both ends; the
widest of them is the run that is hit. All chains through a posting lie in that run, so
the result depends neither on the term it began with nor on the shards.

Defined results: null or wordless texts have no words and no hits; null or
wordless items match nothing; items that share an id count as one item, and so do
all items without an id, which add nothing to the list of ids. Repeated item rows
are one. Repeated document rows each get their own row.
Documents may carry any other columns; they are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import BROADCAST_BYTES, cut, few, ranges_to_index, small_batches, texts, tidy

#: Lower-cases A-Z; every ASCII byte that is no letter or digit becomes a space.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
WINDOW = 10
SHARD_BYTES = 8 << 20
#: Candidates that one step of a search holds.
STEP = 1 << 20
#: Windows that one step of a search writes out.
SOME = 1 << 16
#: Test text, in bytes, that one block of windows may hold: at most half as many windows.
BLOCK_BYTES = 8 << 20

INDEX_SCHEMA = "shard binary, doc_ids array<bigint>, dks array<bigint>, starts binary, terms binary, counts binary, postings binary"
BLOCK_SCHEMA = "shard binary, row int, doc_id long, dk long, n_words long, runs binary, items array<string>"
HIT_SCHEMA = "doc_id long, dk long, n_words long, n_hit long, items array<string>"


def words(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text."""
    return text.translate(WORD_TABLE).split()


class Vocabulary:
    """Distinct words, numbered from 0, as one Arrow array."""

    def __init__(self, terms: pa.Array):
        self.terms = terms

    def __len__(self) -> int:
        return len(self.terms)

    def numbers(self, found: list[bytes] | pa.Array) -> np.ndarray:
        """The number of each word; -1 where it has none."""
        if not len(found):
            return np.zeros(0, np.int64)
        found = pa.array(found, pa.large_binary()) if isinstance(found, list) else found
        return pc.index_in(found, value_set=self.terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


@dataclass
class Windows:
    """Test windows, as places in one stream of term numbers.

    ``stream`` holds the terms of all distinct texts; a window is ``lengths`` terms
    from ``begins`` on; ``owner`` is its text, and a text's items are
    ``names[bounds[t]:bounds[t + 1]]`` (null: items without an id). About 13 bytes a window.
    """

    vocabulary: Vocabulary
    stream: np.ndarray
    begins: np.ndarray
    lengths: np.ndarray
    owner: np.ndarray
    bounds: np.ndarray
    names: pa.Array

    def terms_of(self, which: np.ndarray) -> np.ndarray:
        """The term numbers of those windows; -1 pads."""
        step = np.arange(WINDOW if not len(self.lengths) else int(self.lengths.max()))
        at = self.begins[which][:, None] + step[None]
        return np.where(step[None] < self.lengths[which][:, None], self.stream[np.minimum(at, max(len(self.stream) - 1, 0))].astype(np.int64), -1)

    def items_of(self, which: np.ndarray) -> list[str | None]:
        """The items of those windows, each once and sorted; items without an id are one, the last."""
        found = {x for t in np.unique(self.owner[which]).tolist() for x in self.names[int(self.bounds[t]) : int(self.bounds[t + 1])].to_pylist()}
        return sorted(found, key=lambda x: (x is None, x or ""))


def compile_windows(items: Iterable[tuple[object, bytes]], window: int = WINDOW) -> Windows:
    """Windows of the distinct texts; repeated rows count once."""
    given = list(items)
    ids = pa.array([None if i is None else str(i) for i, _ in given], pa.string())
    return compiled(ids, pa.array([t for _, t in given], pa.large_binary()), window)


def compiled(ids: pa.Array, data: pa.Array, window: int = WINDOW) -> Windows:
    """The same of Arrow columns: nothing is held as Python objects but one text at a time."""
    coded = data.dictionary_encode()
    texts_, text_of = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    order = pa.table({"t": pa.array(text_of), "i": ids}).group_by(["t", "i"]).aggregate([]).sort_by([("t", "ascending"), ("i", "ascending")])
    bounds = np.searchsorted(order.column("t").to_numpy(), np.arange(len(texts_) + 1))
    clean = [x.as_py().translate(WORD_TABLE) for x in texts_]
    split = pc.ascii_split_whitespace(pa.array([x.decode("utf-8", "replace") for x in clean], pa.large_string())) if clean else pa.array([], pa.list_(pa.large_string()))
    del clean
    flat, inner = split.flatten().cast(pa.large_binary()), np.asarray(split.offsets).astype(np.int64) if len(split) else np.zeros(1, np.int64)
    word = pc.not_equal(flat, b"") if len(flat) else pa.array([], pa.bool_())
    before = np.append(0, np.cumsum(word.to_numpy(zero_copy_only=False))).astype(np.int64)
    terms = flat.filter(word).dictionary_encode()
    del flat, split
    ends = before[inner]
    n_words = np.diff(ends)
    n_windows = np.where(n_words > 0, np.maximum(n_words - window + 1, 1), 0)
    owner = np.repeat(np.arange(len(n_words), dtype=np.int32), n_windows)
    begins = ranges_to_index(ends[:-1], n_windows).astype(np.int32)
    lengths = np.minimum(n_words, window)[owner].astype(np.uint8 if window < 256 else np.int32)
    stream = np.asarray(terms.indices).astype(np.int32)
    names = order.column("i").combine_chunks()
    return Windows(Vocabulary(terms.dictionary), stream, begins, lengths, owner, bounds, names)


@dataclass
class Shard:
    """Postings of one shard: ``keys`` = term * span + position, ascending."""

    starts: np.ndarray
    counts: np.ndarray
    keys: np.ndarray
    span: int


def index_shard(docs: list[bytes], vocabulary: Vocabulary) -> Shard:
    parts, starts = [], [0]
    for text in docs:
        parts.append(vocabulary.numbers(words(text)))
        starts.append(starts[-1] + len(parts[-1]))
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    at = np.flatnonzero(ids >= 0)
    span = len(ids) + 2 * WINDOW + 1
    keys = ids[at] * span + at
    keys.sort()
    return Shard(np.array(starts), np.bincount(ids[at], minlength=len(vocabulary)), keys, span)


@dataclass
class _Some:
    """A few windows with their terms written out."""

    terms: np.ndarray
    lengths: np.ndarray


def search(shard: Shard, windows: Windows, slop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window numbers, first positions, ends) of all matches inside single documents."""
    empty = np.zeros(0, np.int64)
    if not len(windows.lengths) or not len(shard.keys):
        return empty, empty, empty
    present = np.append(shard.counts, 0) > 0
    found: list[tuple[np.ndarray, ...]] = []
    for lo in range(0, len(windows.lengths), SOME):
        which = np.arange(lo, min(lo + SOME, len(windows.lengths)))
        terms = windows.terms_of(which)
        live = (present[terms] | (terms < 0)).all(axis=1)  # number -1 is the last: not present, but padding
        if live.any():
            some = _Some(terms[live], windows.lengths[which[live]].astype(np.int64))
            got = _search(shard, some, slop)
            found += [(which[live][w], start, ends) for w, start, ends in got]
    if not found:
        return empty, empty, empty
    return tuple(np.concatenate(x) for x in zip(*found))


def _search(shard: Shard, windows: _Some, slop: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Matches of windows whose terms all occur in the shard, from the rarest term of each on."""
    n = len(shard.counts)
    count = np.where(windows.terms >= 0, np.append(shard.counts, 0)[np.where(windows.terms >= 0, windows.terms, n)], 1 << 60)
    order = np.argsort(count, axis=1, kind="stable")
    live = np.arange(len(count))
    first = windows.terms[live, order[live, 0]]
    begin = np.concatenate([[0], np.cumsum(shard.counts)])[first]
    size = shard.counts[first]
    total, bounds = np.cumsum(size), [0]
    while bounds[-1] < len(live):
        done = total[bounds[-1] - 1] if bounds[-1] else 0
        bounds.append(max(bounds[-1] + 1, int(np.searchsorted(total, done + STEP, "right"))))
    for a, b in zip(bounds, bounds[1:]):
        for lo in range(0, int(size[a:b].max()), STEP):  # a long list goes in several steps
            part = np.minimum(np.maximum(size[a:b] - lo, 0), STEP)
            which = np.repeat(live[a:b], part)
            at = shard.keys[ranges_to_index(begin[a:b] + lo, part)] % shard.span
            if slop:
                which, start, ends = _chains(shard, windows, which, at, order[which, 0], slop)
            else:
                which, start = _phrases(shard, windows, which, at - order[which, 0], order)
                ends = start + windows.lengths[which]
            doc = np.searchsorted(shard.starts, start, "right") - 1
            ok = (start >= 0) & (ends <= shard.starts[np.minimum(doc + 1, len(shard.starts) - 1)])
            yield which[ok], start[ok], ends[ok]


def _phrases(shard: Shard, windows: _Some, which: np.ndarray, start: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The candidates (window, start) of which every term stands in its place, the rarest checked first."""
    for k in range(1, windows.terms.shape[1]):
        if not len(which):
            break
        offset = order[which, k]
        need = windows.terms[which, offset]
        key = need * shard.span + start + offset
        place = np.searchsorted(shard.keys, key)
        ok = (need < 0) | (shard.keys[np.minimum(place, len(shard.keys) - 1)] == key)
        which, start = which[ok], start[ok]
    return which, start


def _chains(shard: Shard, windows: _Some, which: np.ndarray, at: np.ndarray, offset: np.ndarray, slop: int) -> tuple[np.ndarray, ...]:
    """(window, first position, end) of the widest chain through each anchor that has one; chains stay in the anchor's document."""
    doc = np.searchsorted(shard.starts, at, "right") - 1
    floor, top = shard.starts[doc], shard.starts[doc + 1]
    length = windows.lengths[which]

    def reach(toward: int) -> np.ndarray:
        """The farthest position that all remaining terms can be chained to; -1 where they cannot."""
        out = np.full(len(which), -1)
        who, here, step = np.arange(len(which)), at, offset.copy()
        while len(who):
            last = step[who] == (0 if toward < 0 else length[who] - 1)
            if last.any():  # positions of one anchor are in ascending order
                if toward > 0:
                    out[who[last]] = here[last]
                else:
                    out[who[last][::-1]] = here[last][::-1]
            who, here = who[~last], here[~last]
            if not len(who):
                break
            step[np.unique(who)] += toward
            low, high = (here + 1, here + 2 + slop) if toward > 0 else (here - 1 - slop, here)
            low, high = np.maximum(low, floor[who]), np.minimum(high, top[who])
            base = windows.terms[which[who], step[who]] * shard.span
            x, y = np.searchsorted(shard.keys, base + low), np.searchsorted(shard.keys, base + np.maximum(high, low))
            who, here = np.repeat(who, y - x), shard.keys[ranges_to_index(x, y - x)] % shard.span
            pairs = np.unique(who * shard.span + here)
            who, here = pairs // shard.span, pairs % shard.span
        return out

    left, right = reach(-1), reach(1)
    ok = (left >= 0) & (right >= 0)
    return which[ok], left[ok], right[ok] + 1


def hits_of(shard: Shard, windows: Windows, slop: int = 0) -> Iterator[tuple[np.ndarray, list[str]]]:
    """For each document: merged hit word runs ``[[start, end), ...]`` and its items."""
    which, start, ends = search(shard, windows, slop)
    doc = np.searchsorted(shard.starts, start, "right") - 1
    order = np.lexsort((start, doc))
    which, start, ends, doc = which[order], start[order], ends[order], doc[order]
    edges = np.searchsorted(doc, np.arange(len(shard.starts)))
    for d in range(len(shard.starts) - 1):
        a, b = edges[d], edges[d + 1]
        if a == b:
            yield np.zeros((0, 2), np.int64), []
            continue
        s = start[a:b] - shard.starts[d]
        e = np.maximum.accumulate(ends[a:b] - shard.starts[d])
        new = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
        runs = np.stack([s[new], np.append(e[new[1:] - 1], e[-1])], 1)
        yield runs, windows.items_of(which[a:b])


def shards_of(batches: Iterable[pa.RecordBatch], text: str, limit: int = SHARD_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows of about ``limit`` bytes of text, with their texts."""
    for batch in batches:
        docs, start, total = list(texts(batch.column(text))), 0, 0
        for i, x in enumerate(docs):
            if total and total + len(x) > limit:
                yield batch.slice(start, i - start), docs[start:i]
                start, total = i, 0
            total += len(x)
        if start < len(docs):
            yield batch.slice(start), docs[start:]


def blocks(benchmark: DataFrame, item_id: str, text: str, limit: int | None = None) -> Iterator[DataFrame]:
    """The test set in blocks of about ``limit`` bytes, dealt by a hash of item id and text; repeated rows are one."""
    limit = limit or BLOCK_BYTES
    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text"))
    items = cut(items.filter("text is not null").dropDuplicates(["item_id", "text"]), "items", few(benchmark.sparkSession))
    total = items.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    n = 1 + int(total) // limit
    for k in range(n):
        yield items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items


def windows_of(block: DataFrame, window: int = WINDOW) -> Windows:
    table = block.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).toArrow().combine_chunks()
    return compiled(*(table.column(c).combine_chunks().cast(t) for c, t in (("item_id", pa.string()), ("text", pa.large_binary()))), window)


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per shard: its documents (ids, hashes of their texts, where their words begin) and the postings of all its terms.

    Postings are position lists in the order of ``terms``; ``counts`` tells their lengths.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for rows, data in shards_of(batches, "text"):
            sizes, terms, counts, at = postings(data)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([uuid.uuid4().bytes], pa.binary()),
                    pa.array([rows.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    pa.array([rows.column("dk").to_pylist()], pa.list_(pa.int64())),
                    pa.array([np.append(0, np.cumsum(sizes)).astype("<i8").tobytes()], pa.binary()),
                    pa.array([_pressed("\n".join(terms).encode())], pa.binary()),
                    pa.array([_pressed(counts.astype("<i4").tobytes())], pa.binary()),
                    pa.array([_pressed(_steps(at, counts).astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes())], pa.binary()),
                ],
                ["shard", "doc_ids", "dks", "starts", "terms", "counts", "postings"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("dk"), F.col(text).alias("text"))
    return rows.mapInArrow(tidy(run), INDEX_SCHEMA)


def postings(data: list[bytes]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Words of each text; the distinct terms; how often each occurs; the positions of each, one term after the other."""
    clean = [t.translate(WORD_TABLE) for t in data]
    offsets = np.append(0, np.cumsum([len(t) for t in clean])).astype(np.int64)
    split = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(clean), pa.py_buffer(offsets), pa.py_buffer(b"".join(clean))))
    flat = split.flatten()
    inner = split.offsets.to_numpy()
    word = pc.not_equal(flat, "")  # white space at the ends of a text leaves empty pieces
    before = np.append(0, np.cumsum(word.to_numpy(zero_copy_only=False)))
    coded = flat.filter(word).dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False)
    return np.diff(before[inner]), coded.dictionary.to_pylist(), np.bincount(ids, minlength=len(coded.dictionary)), np.argsort(ids, kind="stable")


def _steps(at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions as distances from the one before, in each list."""
    out = np.diff(at, prepend=0)
    first = (np.cumsum(counts) - counts)[counts > 0]
    out[first] = at[first]
    return out


def _pressed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def _unpressed(blob: bytes) -> bytes:
    n = int.from_bytes(blob[:8], "little")
    return pa.decompress(blob[8:], n, "zstd", asbytes=True) if n else b""


def read_shard(row: dict, vocabulary: Vocabulary) -> Shard:
    """The stored shard, restricted and renumbered to ``vocabulary``."""
    starts = np.frombuffer(row["starts"], "<i8").astype(np.int64)
    counts = np.frombuffer(_unpressed(row["counts"]), "<i4").astype(np.int64)
    raw = np.frombuffer(_unpressed(row["postings"]), np.uint8)
    steps = np.ascontiguousarray(raw.reshape(4, -1).T).view("<i4").ravel().astype(np.int64)
    begin = np.cumsum(counts) - counts
    run = np.cumsum(steps)
    at = run - np.repeat(run[begin] - steps[begin], counts) if len(counts) else run
    words = _unpressed(row["terms"]).split(b"\n") if len(counts) else []
    term = np.repeat(vocabulary.numbers(words), counts)
    ok = term >= 0
    span = int(starts[-1]) + 2 * WINDOW + 1
    keys = np.sort(term[ok] * span + at[ok])
    return Shard(starts, np.bincount(term[ok], minlength=len(vocabulary)), keys, span)


def search_index(index: DataFrame, windows: Windows, slop: int = 0) -> DataFrame:
    """Hits of one block of windows: a row for every indexed document, its runs and items."""
    shared = index.sparkSession.sparkContext.broadcast(windows)  # compiled from at most BLOCK_BYTES of text

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                starts = np.frombuffer(row["starts"], "<i8")
                hits = list(hits_of(read_shard(row, shared.value.vocabulary), shared.value, slop))
                n = len(hits)
                columns = [
                    pa.array([row["shard"]] * n, pa.binary()),
                    pa.array(range(n), pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["dks"], pa.int64()),
                    pa.array(np.diff(starts), pa.int64()),
                    pa.array([r.astype("<i8").tobytes() for r, _ in hits], pa.binary()),
                    pa.array([x for _, x in hits], pa.list_(pa.string())),
                ]
                if n:
                    yield pa.RecordBatch.from_arrays(columns, ["shard", "row", "doc_id", "dk", "n_words", "runs", "items"])

    hits = index.mapInArrow(tidy(run), BLOCK_SCHEMA)
    hits._graphloom_broadcast = shared
    return hits


def merge_runs(parts: list[np.ndarray]) -> np.ndarray:
    if not parts:
        return np.zeros((0, 2), np.int64)
    r = np.concatenate(parts)
    if not len(r):
        return r
    r = r[np.argsort(r[:, 0], kind="stable")]
    e = np.maximum.accumulate(r[:, 1])
    new = np.flatnonzero(np.concatenate([[True], r[1:, 0] > e[:-1]]))
    return np.stack([r[new, 0], np.append(e[new[1:] - 1], e[-1])], 1)


def all_hits(docs: DataFrame, benchmark: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, slop: int = 0) -> DataFrame:
    """doc_id, dk, n_words, n_hit, items of every document, over all blocks of the test set in turn."""
    index = cut(build_index(docs, doc_id, text), "postings")
    parts: list[DataFrame] = []
    more = iter(blocks(benchmark, item_id, item_text))
    block = next(more)
    while block is not None:
        hits, block = search_index(index, windows_of(block), slop), next(more, None)
        if block is None and not parts:  # one block, as usual: its hits are all
            return hits.mapInArrow(tidy(_summed), HIT_SCHEMA)
        # the documents without a hit are told by the last block
        parts.append(cut(hits if block is None else hits.filter("size(items) > 0"), "hits"))
        hits._graphloom_broadcast.destroy()
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    one = every.groupBy("shard", "row").agg(
        *(F.first(c).alias(c) for c in ("doc_id", "dk", "n_words")), F.collect_list("runs").alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    )
    return one.select("doc_id", "dk", "n_words", F.expr("aggregate(runs, cast('' as binary), (a, r) -> concat(a, r))").alias("runs"), "items").mapInArrow(tidy(_summed), HIT_SCHEMA)


def _summed(batches):
    for b in batches:
        n_hit = []
        for blob in b.column("runs").to_pylist():
            runs = merge_runs([np.frombuffer(blob, "<i8").reshape(-1, 2)])
            n_hit.append(int((runs[:, 1] - runs[:, 0]).sum()))
        items = [sorted(x, key=lambda i: (i is None, i or "")) for x in b.column("items").to_pylist()]
        columns = [*(b.column(c) for c in ("doc_id", "dk", "n_words")), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "dk", "n_words", "n_hit", "items"])


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", slop: int = 0) -> DataFrame:
    """Store the index, search it for every test window, and return one row per document."""
    hits = all_hits(docs, benchmark, doc_id, text, item_id, item_text, slop)
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no test window; all columns kept, whatever their names.

    The stored index is searched; rows go by their id and a hash of their text.
    """
    hits = all_hits(docs, benchmark, doc_id, text, item_id, item_text)
    gone = cut(hits.filter("n_hit > 0").select("doc_id", "dk").distinct(), "contaminated", few(docs.sparkSession))
    small = gone.count() * 16 <= BROADCAST_BYTES
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    marked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("dk"), row.alias("row"))
    same = marked["doc_id"].eqNullSafe(gone["doc_id"]) & (marked["dk"] == gone["dk"])
    return marked.join(F.broadcast(gone) if small else gone.hint("merge"), same, "left_anti").select("row.*")
