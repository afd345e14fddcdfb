"""Similarity self-join and greedy leaders: each row joins the first earlier leader that is close enough, or leads.

Rows are taken by ascending id; a row whose cosine to an earlier leader is at
least the threshold belongs to the first such leader, any other row is a leader.
That is the lexicographically first independent set of the similarity graph, so
it depends only on each row's earlier neighbours:

* Neighbours meet in buckets: bands of signs on random hyperplanes, so many that a pair at the threshold shares none with probability ``MISS``;
  cosines are then computed exactly. Where bands would cost more than they save (few rows, or
  a low threshold) all rows are one bucket. Equal vectors are one row from the start.
* A bucket is never compared pair by pair. Its rows are dealt into blocks that
  each meet the bucket's ``head``, its smallest undecided or leading ids, and a
  row keeps its ``KEEP`` smallest neighbours. Up to its *horizon* a row then
  knows all its neighbours, and is decided as soon as the first of them that is
  not a member leads (it joins), or none is left and it knows all (it leads).
* Rows that stay undecided meet larger heads in a next pass, among what is left.
  A bucket of copies is decided in the first pass, as they all know its first rows.

Decisions follow the edges in rounds of joins; a set of edges within
``LOCAL_EDGES`` (counted) is walked in order by one task instead.

Rows without a usable vector, and vectors of length zero, lead themselves. Of
rows that share an id the smallest vector counts. Empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.lineage import cut
from graphloom.operators.vectors import matrix, unit, usable

THRESHOLD = 0.92
#: Probability that a pair at the threshold is not found.
MISS = 1e-9
#: Smallest ids of a bucket that its rows are compared with in the first pass; four times as many in each next one.
HEAD = 1024
#: Earlier neighbours that a row keeps of a bucket.
KEEP = 16
#: Edges up to which one task decides.
LOCAL_EDGES = 1_000_000
#: Rounds after which what was decided is written as one table.
FOLD = 8
#: Comparisons that cost as much as dealing a row into one more bucket (it is shuffled, read and written).
DEAL = 1000
#: Where all rows are one bucket: blocks that they are dealt into at least, and bytes of a block's vectors.
SPREAD, BLOCK_BYTES = 8, 32 << 20
#: Cosines computed at once, in single precision; components of the pairs that are then computed in double.
AT_ONCE, EXACT = 1 << 22, 1 << 22
#: Stands for "all": larger than every id.
ALL = (1 << 63) - 1
STATE = "id long, leader long"


def bands_for(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """Bits of a band and the number of bands: as many as leave at most ``miss`` at the threshold, with the bits that cost least (rows dealt, and unlike rows of a bucket compared).

    No bits: one bucket of all rows.
    """
    same = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    bands = lambda bits: 1 if same >= 1 or not bits else math.ceil(math.log(miss) / math.log1p(-(same**bits)))
    bits = min([0, *range(4, 21)], key=lambda b: bands(b) * (1 + n / 2**b / DEAL))
    return bits, bands(bits)


def banded(rows: DataFrame, bits: int, bands: int, seed: int) -> DataFrame:
    """(bucket, id, v) for each band; v of unit length."""

    def run(batches):
        planes = None
        for b in batches:
            m = unit(matrix(b.column(1)))
            if not len(m):
                continue
            if planes is None:
                planes = np.random.default_rng(seed).normal(size=(bands * bits, m.shape[1]))
            key = ((m @ planes.T > 0).reshape(len(m), bands, bits) * (1 << np.arange(bits))).sum(2) + (np.arange(bands)[None] << bits)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))
            for lo in range(0, bands, 8):  # a few bands at a time: batches stay small
                part = key[:, lo : lo + 8]
                at = pa.array(np.repeat(np.arange(len(m)), part.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(part.ravel()), b.column(0).take(at), flat.take(at)], names=["bucket", "id", "v"])

    return rows.mapInArrow(run, "bucket long, id long, v array<double>")


def buckets_of(once: DataFrame, n: int, threshold: float, seed: int) -> tuple[DataFrame, bool]:
    """(bucket, id, v), and whether all rows are one bucket."""
    bits, count = bands_for(n, threshold)
    return (cut(banded(once, bits, count, seed)), False) if bits else (once.select(F.lit(0).cast("long").alias("bucket"), "id", "v"), True)


def _close(m: np.ndarray, h: np.ndarray, threshold: float):
    """(rows of ``m``, rows of ``h``, cosine) of pairs of unit vectors at the threshold, some rows of ``m`` a time; ordered by both.

    Single precision leaves out what is below the threshold by more than its error; the rest is computed in double.
    """
    width = m.shape[1]
    m32, h32 = m.astype(np.float32), h.astype(np.float32).T
    least = np.float32(threshold - (width + 4) * 2.0**-23)
    for lo in range(0, len(m), max(1, AT_ONCE // len(h))):
        at = np.flatnonzero(m32[lo : lo + max(1, AT_ONCE // len(h))] @ h32 >= least)
        r, c = at // len(h) + lo, at % len(h)
        s = np.empty(len(at))
        for k in range(0, len(at), max(1, EXACT // width)):
            part = slice(k, k + max(1, EXACT // width))
            s[part] = np.einsum("ij,ij->i", m[r[part]], h[c[part]])
        s = np.round(s, 9)
        yield r[s >= threshold], c[s >= threshold], s[s >= threshold]


def _compare(threshold: float, keep: int):
    """Of one block of a bucket: (id, near) for the ``keep`` smallest earlier neighbours in the head, and (id, null, horizon)."""

    def run(block: pa.Table, head: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 3]
        if block.num_rows and head.num_rows:
            ids, first = (np.asarray(t.column("id").combine_chunks()) for t in (block, head))
            whole = bool(head.column("whole")[0].as_py())
            order = np.argsort(first)
            first, h = first[order], unit(matrix(head.column("v")))[order]
            last = np.full(len(ids), ALL)
            for r, c, _ in _close(unit(matrix(block.column("v"))), h, threshold):
                earlier = first[c] < ids[r]
                r, c = r[earlier], c[earlier]
                nth = np.arange(len(r)) - np.searchsorted(r, r)
                r, c, nth = r[nth < keep], c[nth < keep], nth[nth < keep]
                out.append((ids[r], first[c], np.full(len(r), ALL)))
                last[r[nth == keep - 1]] = first[c[nth == keep - 1]]
            seen = np.where(whole | (ids <= first[-1]), ALL, first[-1])
            out.append((ids, np.full(len(ids), ALL), np.minimum(last, seen)))
        a, b, c = map(np.concatenate, zip(*out, strict=True))
        return pa.table({"id": a, "near": pa.array(b, mask=b == ALL), "horizon": c})

    return run


def neighbours(live: DataFrame, asked: DataFrame, head: int, threshold: float, keep: int, single: bool = False) -> DataFrame:
    """(id, near, horizon) rows of every asked row in every bucket that it shares; ``single``: all rows are one bucket."""
    again = [F.col(c).alias(c) for c in ("bucket", "id", "v")]  # names of their own: both sides come from one table
    if single:
        # the head by its largest id: no task sorts the bucket
        first = live.select("id").orderBy("id").limit(head + 1)
        n, upto = first.count(), first.limit(head).agg(F.max("id")).first()[0]
        rows = asked.count()
        blocks = max(1, -(-rows // head), min(2 * SPREAD, -(-rows // HEAD)))
        heads = live.filter(F.col("id") <= F.lit(upto)).select(*again, F.lit(n <= head).alias("whole"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        blocks = asked.select("bucket", "id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    else:
        size = live.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / head).cast("int"))
        rank = F.row_number().over(Window.partitionBy("bucket").orderBy("id"))
        heads = live.withColumn("r", rank).filter(F.col("r") <= head).drop("r").join(size, "bucket")
        heads = heads.select(*again, (F.col("n") <= head).alias("whole"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        blocks = asked.join(size, "bucket").select("bucket", "id", "v", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    return blocks.groupBy("bucket", "block").cogroup(heads.groupBy("bucket", "block")).applyInArrow(_compare(threshold, keep), "id long, near long, horizon long")


def _walk(edges: pa.Table) -> pa.Table:
    """Decide rows by ascending id; ``state``: 0 undecided before, otherwise the leader that was decided for ``near``."""
    ids, near, horizon, leader = (np.asarray(edges.column(c).combine_chunks().fill_null(-1)) for c in ("id", "near", "horizon", "known"))
    order = np.lexsort((near, ids))
    ids, near, horizon, leader = (x[order] for x in (ids, near, horizon, leader))
    starts = np.flatnonzero(np.diff(ids, prepend=ids[:1] - 1))
    decided: dict[int, int] = {}
    blocked: set[int] = set()
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True):
        i, upto = int(ids[lo]), int(horizon[lo])
        for u, known in zip(near[lo:hi].tolist(), leader[lo:hi].tolist(), strict=True):
            if u < 0:
                continue
            to = known if known >= 0 else decided.get(u, -1)
            if u in blocked or (to < 0 and u in decided):
                break
            if to == u:
                if u <= upto:
                    decided[i] = u
                break
            if to < 0:
                break
        else:
            if upto == ALL:
                decided[i] = i
        if i not in decided:
            blocked.add(i)
    return pa.table({"id": pa.array(list(decided), pa.int64()), "leader": pa.array(list(decided.values()), pa.int64())})


def _rounds(edges: DataFrame, state: DataFrame) -> DataFrame:
    """The same by joins: each round decides all rows whose earlier neighbours tell."""
    done, rounds = state, 0
    while True:
        told = edges.join(done.select(F.col("id").alias("near"), F.col("leader").alias("of")), "near", "left")
        told = told.join(done.select("id"), "id", "left_anti")
        live = F.col("of").isNull() | (F.col("of") == F.col("near"))
        first = told.groupBy("id").agg(F.min(F.when(F.col("near").isNotNull() & live, F.struct("near", F.col("of").isNotNull().alias("leads")))).alias("f"), F.first("horizon").alias("horizon"))
        leads = F.col("f").isNull() & (F.col("horizon") == ALL)
        joins = F.col("f.leads") & (F.col("f.near") <= F.col("horizon"))
        new = cut(first.select("id", F.when(leads, F.col("id")).when(joins, F.col("f.near")).alias("leader")).filter("leader is not null"))
        if new.isEmpty():
            return done
        rounds += 1
        done = done.unionByName(new) if rounds % FOLD else cut(done.unionByName(new))


def _decide(edges: DataFrame, state: DataFrame, local_edges: int) -> DataFrame:
    """State after what these edges decide."""
    if edges.count() > local_edges:
        return cut(_rounds(edges, state))
    known = edges.join(state.select(F.col("id").alias("near"), F.col("leader").alias("known")), "near", "left")
    new = known.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_walk, STATE)
    return cut(state.unionByName(new))


def _given(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, v): the smallest usable vector of each id; components stay floats where they were given as such."""
    given = usable(rows, id_column, vector).filter(F.exists("v", lambda x: x != 0)).groupBy("id").agg(F.min("v").alias("v"))
    return given.withColumn("v", F.col("v").cast("array<float>")) if rows.schema[vector].dataType.simpleString() == "array<float>" else given


def _once(given: DataFrame) -> DataFrame:
    """(id, v): of equal vectors the one of the smallest id."""
    return given.groupBy("v").agg(F.min("id").alias("id")).select("id", "v")


def leaders(rows: DataFrame, threshold: float = THRESHOLD, id_column: str = "vec_id", vector: str = "embedding", seed: int = 5, head: int = HEAD, keep: int = KEEP, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, leader) of every id."""
    ids = rows.select(F.col(id_column).cast("long").alias("id")).filter("id is not null").distinct()
    given = cut(_given(rows, id_column, vector))
    once = cut(_once(given))
    buckets, single = buckets_of(once, once.count(), threshold, seed)
    spark = rows.sparkSession
    state, left = spark.createDataFrame([], STATE), None
    live = asked = buckets
    while left is None or left.take(1):
        found = cut(neighbours(live, asked, head, threshold, keep, single))
        horizon = found.groupBy("id").agg(F.min("horizon").alias("horizon"))
        near = found.filter("near is not null").select("id", "near").distinct()
        edges = cut(horizon.join(near, "id", "left").select("id", "near", "horizon"))
        # rows that share no bucket with a live row know all their neighbours: none
        alone = (once if left is None else left).select("id").join(horizon.select("id"), "id", "left_anti").select("id", F.col("id").alias("leader"))
        state = _decide(edges, cut(state.unionByName(alone)), local_edges)
        left = once.select("id").join(state.select("id"), "id", "left_anti")
        live = buckets.join(state.filter("leader <> id").select("id"), "id", "left_anti").select("bucket", "id", "v")
        asked = buckets.join(left, "id", "left_semi").select("bucket", "id", "v")
        if single:  # far fewer rows than there were
            live, asked = cut(live), cut(asked)
        head *= 4
    same = given.join(once.select("v", F.col("id").alias("rep")), "v").select("id", "rep")
    led = same.join(state.select(F.col("id").alias("rep"), "leader"), "rep").select("id", "leader")
    return ids.join(led, "id", "left").select("id", F.coalesce("leader", "id").alias("leader"))


def similar_pairs(rows: DataFrame, threshold: float = THRESHOLD, id_column: str = "vec_id", vector: str = "embedding", seed: int = 5) -> DataFrame:
    """(id, near, cosine) of all pairs of different vectors at the threshold or above, near < id: the self-join itself, for sets whose pairs may be listed.

    Every bucket is compared block by block, so its size bounds no task; equal vectors are not paired.
    Two blocks meet once. Where all rows are one bucket their blocks are as large as ``BLOCK_BYTES``
    allow, so a row is sent to ``SPREAD`` + 1 tasks until rows are more than that many blocks hold.
    """
    given = cut(_once(_given(rows, id_column, vector)))
    n, width = given.agg(F.count("*"), F.max(F.size("v"))).first()
    buckets, single = buckets_of(given, n, threshold, seed)
    if single:
        blocks = max(-(-n * 8 * (width or 1) // BLOCK_BYTES), min(SPREAD, -(-n // HEAD)), 1)
        dealt = buckets.withColumn("blocks", F.lit(blocks))
    else:
        size = buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket", F.ceil(F.col("n") / HEAD).cast("int").alias("blocks"))
        dealt = buckets.join(size, "bucket")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    a = dealt.select("bucket", "block", F.explode(F.sequence("block", F.col("blocks") - 1)).alias("other"), "id", "v")
    b = dealt.select(F.col("bucket").alias("bucket"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("block"), F.col("block").alias("other"), F.col("id").alias("id"), F.col("v").alias("v"))

    def run(key: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if x.num_rows and y.num_rows:
            i, j = (np.asarray(t.column("id").combine_chunks()) for t in (x, y))
            own = key[1] == key[2]
            for r, c, s in _close(unit(matrix(x.column("v"))), unit(matrix(y.column("v"))), threshold):
                p, q = i[r], j[c]
                once = (q < p) | (not own)  # a block meets itself: each pair twice
                out.append((np.maximum(p, q)[once], np.minimum(p, q)[once], s[once]))
        return pa.table(dict(zip(["id", "near", "cosine"], map(np.concatenate, zip(*out, strict=True)), strict=True)))

    keys = ["bucket", "block", "other"]
    found = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(run, "id long, near long, cosine double")
    return found if single else found.dropDuplicates(["id", "near"])


def unique_questions(questions: DataFrame, vectors: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Questions (id, text, persona, kind) of which one a group stays, with its size, personas and kinds; and the members (id, leader).

    Texts are compared trimmed and in lower case by their ``vectors`` (id, v).
    The members are a table rather than a list a group, so that no group has to fit a row.
    """
    members = cut(leaders(vectors, threshold, "id", "v"))
    joined = questions.join(members, "id").withColumn("persona", F.nullif(F.trim("persona"), F.lit("")))
    about = joined.groupBy("leader").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("persona")), "; ").alias("personas"), F.array_join(F.array_sort(F.collect_set("kind")), "; ").alias("kinds"))
    first = questions.select(F.col("id").alias("leader"), F.lower(F.trim("text")).alias("text"))
    return about.join(first, "leader").select(F.col("leader").alias("id"), "text", "n", "personas", "kinds"), members
