"""Substring deduplication over words: seed and extend.

A window of 50 words is removed from a document if the same words start in a
document with a smaller id; overlapping windows merge into maximal repeats.
Documents are joined on winnowed anchors (see ``repeats``). Occurrences of one
anchor that differ in their surroundings are extended from it, word by word to
the left and to the right, all at once: after each step, those that agree so far
form a class. Two occurrences share a window of ``a`` words to the left of the
anchor and ``b`` to the right exactly if they are in one class after ``a`` steps to the
left and in one after ``b`` to the right, so no pairs are compared. Adjacent windows merge
into maximal repeats.

Defined results: null, empty and short texts keep all their words; a missing id
sorts after all others; rows that share an id never remove from each other;
repeated rows each get a row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from graphloom.llm.common import NO_ID, mix, texts, tidy
from graphloom.llm.repeats import Spec, Sums, covered, keyed, merged, winnow, with_repeats

WINDOW, SEED_WORDS = 50, 20
#: Words whose hashes a worker remembers.
KNOWN = 400_000
_known: dict[bytes, int] = {}


def word_values(text: bytes) -> np.ndarray:
    words = text.split()
    if len(_known) > KNOWN:
        _known.clear()
    for w in set(words).difference(_known):
        _known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def cut_out(text: bytes, at: list[tuple[int, int]]) -> list[bytes]:
    words = text.split()
    return [b" ".join(words[p : p + n]) for p, n in at]


def _classes(*keys: np.ndarray) -> np.ndarray:
    """Numbers of the distinct rows of ``keys``."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def extend(rows: list[tuple], window: int, k: int, values=word_values) -> list[tuple]:
    """Repeats among contexts (id, dk, place, n, context) of anchors of ``k`` words: n windows start at place, all on one anchor."""
    parts = [values(r[4]) for r in rows]
    ids, dks, places, counts = (np.array([r[c] for r in rows], np.int64) for c in range(4))
    joined = np.concatenate(parts)
    ends = np.cumsum([len(p) for p in parts])
    starts = np.append(0, ends[:-1])
    grams = mix(Sums(joined).all(k))
    anchor = winnow(grams, window - k + 1)[starts]  # of the first window, and so of all
    seed = _classes(grams[anchor])
    room = window - k

    def steps(toward: int, first: np.ndarray) -> list[np.ndarray]:
        """Classes after 0, 1, ... words; -1 - row where the context has no more."""
        out, now = [seed], seed
        for a in range(room):
            at = first + toward * a
            inside = (at >= starts) & (at < ends)
            now = np.where(inside & (now >= 0), now, -1 - np.arange(len(rows)))
            now = np.where(now >= 0, _classes(now, joined[np.clip(at, 0, len(joined) - 1)]), now)
            out.append(now)
        return out

    left, right = steps(-1, anchor - 1), steps(1, anchor + k)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for a in range(room + 1):
        begin = anchor - a - starts
        here = np.flatnonzero((begin >= 0) & (begin < counts))
        if not len(here):
            continue
        same = _classes(left[a][here], right[room - a][here])
        least = np.full(int(same.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, same, ids[here])
        later = here[ids[here] > least[same]]
        found.append((later, places[later] + begin[later]))
    who, at = (np.concatenate(x) for x in zip(*found))
    return merged(ids[who], dks[who], at, window)


def spec(window: int = WINDOW) -> Spec:
    k = max(1, window * SEED_WORDS // WINDOW)
    return Spec(window=window, k=k, values=word_values, within=False, cut_out=cut_out, in_block=lambda rows: extend(rows, window, k))


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    rows = with_repeats(keyed(docs.select(doc_id, text), doc_id, text), text, spec(window))

    def run(batches):
        for b in batches:
            out = []
            for i, t, blobs in zip(b.column("__id").to_pylist(), texts(b.column(text)), b.column("__blobs").to_pylist()):
                words = t.split()
                gone = covered(blobs, len(words))
                kept = [w for w, g in zip(words, gone.tolist()) if not g] if blobs else words
                out.append((None if i == NO_ID else i, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            columns = zip(*out) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(tidy(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")
