"""Best-fit packing after the Martello-Toth dominance reduction.

Documents are cut into pieces of at most ``capacity`` tokens and the pieces put
into as few sequences as the method can. A plan depends only on how many pieces
there are of each length, so it is made from a histogram of at most ``capacity``
rows, however large the corpus; pieces of one length are interchangeable and
take the plan's slots in order of their rank.

The reduction fixes sets that dominate every other way to fill a sequence with
their longest piece: an exactly filling pair; a piece that nothing fits beside;
the longest partner where only one piece fits, or where it is at least as long
as any fitting pair; and a pair of partners that leaves no better choice for
either. Fixed sets are removed for as many sequences as the counts allow, until
nothing more can be fixed. What is left is packed best-fit in decreasing order,
all pieces of one length at once.

Ranks need no global sort: tasks number their pieces within each length, and
the counts of (task, length) give each task's first rank.

Defined results: a null text is empty and is one piece with only the end id; a
null id stays null; repeated rows are packed once each; an empty table gives no
sequences.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import chunks, cut, few, small_batches, texts, tidy
from graphloom.llm.tokens import TOKENIZER, encoder, with_end

CAPACITY, END = 2048, 0
PIECES_SCHEMA = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, local_rank long"

#: Lengths in one sequence, and how many sequences are filled so.
Pattern = tuple[tuple[int, ...], int]


def reduce_dominated(counts: Counter[int], capacity: int = CAPACITY) -> tuple[list[Pattern], Counter[int]]:
    """Sets fixed by dominance, and the counts that are left."""
    left, fixed = Counter({w: n for w, n in counts.items() if n}), []

    def take(*lengths: int) -> None:
        need = Counter(lengths)
        times = min(left[w] // n for w, n in need.items())
        for w, n in need.items():
            left[w] -= n * times
            if not left[w]:
                del left[w]
                present[w] = False
        fixed.append((tuple(sorted(lengths, reverse=True)), times))

    present = np.zeros(capacity + 1, bool)
    present[list(left)] = True

    def longest(limit: int, taken: Counter[int]) -> int:
        """The longest available length up to ``limit`` besides those taken; 0 if none."""
        for w in np.flatnonzero(present[: max(limit, 0) + 1])[::-1].tolist():
            if left[w] > taken[w]:
                return w
        return 0

    changed = True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while left[j]:
                room, mine = capacity - j, Counter([j])
                best = longest(room, mine)
                if not best:
                    take(j)
                elif best == room:
                    take(j, best)
                else:
                    short = []
                    for w in np.flatnonzero(present).tolist():
                        short += [w] * min(3, left[w] - (w == j))
                        if len(short) >= 3:
                            break
                    if len(short) < 2 or short[0] + short[1] > room:
                        take(j, best)
                    elif len(short) < 3 or sum(short[:3]) > room:
                        second = longest(room - best, mine + Counter([best]))
                        if best >= _best_pair(left, j, room):
                            take(j, best)
                        elif second and second >= longest(room // 2, mine):
                            take(j, best, second)
                        else:
                            break
                    else:
                        break
                changed = True
    return fixed, left


def _best_pair(left: Counter[int], j: int, room: int) -> int:
    """The largest sum of two pieces besides one of ``j`` that fits into ``room``."""
    lengths = sorted(w for w, n in left.items() if n > (w == j))
    best, lo, hi = 0, 0, len(lengths) - 1
    while lo <= hi:
        s = lengths[lo] + lengths[hi]
        if s > room:
            hi -= 1
            continue
        if lo < hi or left[lengths[lo]] - (lengths[lo] == j) > 1:
            best = max(best, s)
        lo += 1
    return best


def best_fit(counts: Counter[int], capacity: int = CAPACITY) -> list[Pattern]:
    """Best-fit decreasing over counts: every placement moves a whole group of like sequences."""
    open_by_room: dict[int, list[Pattern]] = defaultdict(list)
    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            room = next((r for r in range(w, capacity + 1) if open_by_room.get(r)), None)
            if room is None:
                q = capacity // w
                if n >= q:
                    open_by_room[capacity - q * w].append(((w,) * q, n // q))
                if n % q:
                    open_by_room[capacity - n % q * w].append(((w,) * (n % q), 1))
                n = 0
            else:
                pattern, times = open_by_room[room].pop()
                t = min(times, n)
                if times > t:
                    open_by_room[room].append((pattern, times - t))
                open_by_room[room - w].append(((*pattern, w), t))
                n -= t
    return [p for r in sorted(open_by_room) for p in open_by_room[r]]


def plan(counts: Counter[int], capacity: int = CAPACITY) -> list[Pattern]:
    fixed, left = reduce_dominated(counts, capacity)
    return fixed + best_fit(left, capacity)


class Slots:
    """Where the r-th piece of a length goes: sequence number and offset."""

    def __init__(self, patterns: list[Pattern], capacity: int = CAPACITY):
        rows: list[tuple[int, int, int, int]] = []
        sequence, used = 0, Counter()
        for lengths, times in patterns:
            offset = 0
            for w in lengths:
                rows.append((w, used[w], sequence, offset))
                used[w] += times
                offset += w
            sequence += times
        rows.sort()
        self.n = sequence
        table = np.array(rows, np.int64).reshape(-1, 4)
        self.length, self.rank, self.sequence, self.offset = table.T
        self.span = int(max(used.values(), default=0)) + 1
        self.keys = self.length * self.span + self.rank

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.keys, length * self.span + rank, "right") - 1
        return self.sequence[k] + rank - self.rank[k], self.offset[k]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document, numbered within its task and length."""
    small_batches(docs.sparkSession)

    def run(batches):
        part, encode = TaskContext.get().partitionId(), encoder(tokenizer)
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            data = list(texts(b.column("text")))
            ids = b.column("doc_id").to_pylist()
            for lo, hi in chunks(np.fromiter(map(len, data), np.int64, len(data))):
                flat, sizes = with_end(*encode(data[lo:hi]), end)
                raw, rows, at = flat.astype("<u4"), [], 0
                for i, n in zip(ids[lo:hi], sizes.tolist()):
                    for k in range(0, n, capacity):
                        m = min(capacity, n - k)
                        rows.append((i, k // capacity, k, m, zlib.crc32(raw[at + k : at + k + m]), part, int(seen[m])))
                        seen[m] += 1
                    at += n
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"]
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return cut(rows.mapInArrow(tidy(run), PIECES_SCHEMA).repartition(few(docs.sparkSession)), "pieces")


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cutup = pieces(docs, doc_id, text, tokenizer, capacity=capacity)
    by_task = cutup.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = Counter({r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()})  # at most `capacity` rows
    shared = docs.sparkSession.sparkContext.broadcast(Slots(plan(counts, capacity), capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = by_task.select("part", "length", F.coalesce(before, F.lit(0)).alias("first"))
    ranked = cutup.join(first, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("local_rank")).alias("rank"))

    def run(batches):
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            sequence, offset = shared.value(length, b.column("rank").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "piece", "start")), pa.array(length), b.column("ids_crc32"), pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
