"""Quality classifier: hashed word n-gram logistic regression, trained with FTRL-proximal.

Words are runs of letters and digits (any non-ASCII character counts as a
letter) and runs of other visible characters. Features are hashed word unigrams
and bigrams; a bigram of one word with itself is the marker "repeat". Values are
``log(1 + count)``, scaled to unit length. The model is one weight per hash
bucket and a bias; FTRL keeps most weights at exactly zero. A score is the
logistic function of a sparse dot product.

Training reads a bounded sample: at most ``max_rows`` labelled rows, those with
the smallest hash of their id, in hash order. Everything else (scoring) covers
all rows. Only the texts are ever inputs of a score.

Defined results: a null text scores as an empty one; without labels of both
kinds every score is the mean label (0.5 without labels); rows with a null id
are scored like others and are never held out; repeated rows each get a row.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from graphloom.llm.common import mix, small_batches, texts, tidy, whole_rows

#: Labelled rows that training reads at most.
MAX_TRAIN_ROWS = 8_000
HASH_BITS = 20
THRESHOLD = 0.7
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.05, 0.02, 4
WORD = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^\sA-Za-z0-9\x80-\xff]+")
REPEAT = np.uint64(0x9E3779B97F4A7C15)


class Hasher:
    """Texts to sparse unit vectors; the hash of a word is remembered while memory allows."""

    def __init__(self, bits: int = HASH_BITS, limit: int = 200_000):
        self.mask, self.limit = np.uint64((1 << bits) - 1), limit
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        found = WORD.findall(text)
        if not found:
            return np.zeros(0, np.int32), np.zeros(0, np.float32)
        for w in set(found).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        pair = np.where(h[1:] == h[:-1], REPEAT, h[:-1] * np.uint64(3) + h[1:])
        index, count = np.unique(np.concatenate([h & self.mask, mix(pair) & self.mask]).astype(np.int64), return_counts=True)
        value = np.log1p(count)
        return index.astype(np.int32), (value / math.sqrt(float(value @ value))).astype(np.float32)


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], bits: int = HASH_BITS) -> tuple[float, np.ndarray]:
    """FTRL-proximal over the rows in the order given; returns the bias and all weights."""
    mean = sum(labels) / len(labels) if labels else 0.5
    weights = np.zeros(1 << bits, np.float32)
    if not 0 < mean < 1:
        return math.log(max(mean, 1e-6) / max(1 - mean, 1e-6)), weights
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias, bias_n = math.log(mean / (1 - mean)), 1.0

    def at(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for (i, x), y in zip(rows, labels):
            w = at(i)
            g = sigmoid(bias + float(w @ x)) - y
            gx = g * x
            grown = n[i] + gx * gx
            z[i] += gx - (np.sqrt(grown) - np.sqrt(n[i])) / ALPHA * w
            n[i] = grown
            bias_n += g * g
            bias -= 0.05 / math.sqrt(bias_n) * g
    weights[:] = at(np.arange(1 << bits))
    return bias, weights


def held_out(doc_id: str):
    """Whether a row is kept from training: crc32 of its id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_TRAIN_ROWS) -> tuple[float, np.ndarray]:
    """The model, trained in one task on at most ``max_rows`` labelled rows."""
    spark = docs.sparkSession
    small_batches(spark)
    chosen = (
        labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .withColumn("rank", F.xxhash64("doc_id"))
        .orderBy("rank", "doc_id", "label")
        .limit(max_rows)
    )
    pairs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    # ids may repeat, so the rows are cut once more, in a fixed order
    pairs = pairs.withColumn("tie", F.xxhash64("text")).orderBy("rank", "doc_id", "label", "tie").limit(max_rows)

    def run(batches):
        hasher, rows = Hasher(), []
        for b in batches:
            for rank, i, y, t in zip(b.column("rank").to_pylist(), b.column("doc_id").to_pylist(), b.column("label").to_pylist(), texts(b.column("text"))):
                rows.append((rank, i, y, hasher(t)))
        rows.sort(key=lambda r: (r[0], r[1], r[2], len(r[3][0]), r[3][0].tobytes()))
        bias, weights = train([r[3] for r in rows], [r[2] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([float(bias)]), pa.array([weights.tobytes()], pa.binary())], ["bias", "weights"])

    row = pairs.repartition(1).mapInArrow(tidy(run), "bias double, weights binary").first()
    if row is None:  # an empty frame may never reach the task
        return 0.0, np.zeros(1 << HASH_BITS, np.float32)
    return row.bias, np.frombuffer(row.weights, np.float32)


def scorer(docs: DataFrame, model: tuple[float, np.ndarray]):
    """A function of texts to scores, for Python workers; the model's size is fixed by HASH_BITS."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(data, hasher: Hasher) -> np.ndarray:
        bias, weights = shared.value
        out = []
        for t in data:
            i, x = hasher(t)
            out.append(sigmoid(bias + float(weights[i] @ x)))
        return np.array(out, float)

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    score = scorer(docs, fit(docs, labels, doc_id, text, label))

    def run(batches):
        hasher = Hasher()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score(texts(b.column("text")), hasher))], ["doc_id", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), "doc_id long, score double")
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the classifier accepts, all columns kept, whatever their names.

    Without labels of both kinds there is nothing to learn from: all rows are kept.
    """
    model = fit(docs, labels, text=text)
    if not model[1].any():
        return docs
    score = scorer(docs, model)
    rows = whole_rows(docs, "doc_id", text).select("text", "row")

    def run(batches):
        hasher = Hasher()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("row")], ["row"]).filter(pa.array(score(texts(b.column("text")), hasher) >= threshold))

    return rows.mapInArrow(tidy(run), StructType([StructField("row", docs.schema)])).select("row.*")
