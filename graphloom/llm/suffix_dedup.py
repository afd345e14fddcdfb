"""Suffix-array deduplication over bytes, by linear grouping construction.

A byte is removed if a 100-byte string that covers it also starts earlier (in a
document with a smaller id, or earlier in the same one). One suffix array of the
whole corpus would be one task; so its suffixes are dealt out. All suffixes that
begin with one 100-byte string share that string's anchor (see ``repeats``), so
each anchor's suffixes can be sorted on their own. Where all occurrences of an
anchor have one and the same context, the order of the suffixes is their order
in the corpus and there is nothing to sort. The other anchors' contexts are
brought together in blocks of bounded size; each block's suffix array is built by
linear grouping, and suffixes that share their first 100 bytes stand together in
it: all but the earliest are repeats. An anchor whose different contexts exceed a
block (a passage in very many surroundings) is split by the hash of its
100-byte strings instead, which is exact as well.

Defined results: null and empty texts keep nothing and lose nothing; texts under
100 bytes are kept; a missing id sorts after all others; rows that share an id
are one document to each other: equal places in them are not earlier than one
another; repeated rows each get a row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from graphloom.llm.common import NO_ID, mix, ranges_to_index, texts, tidy, whole_rows
from graphloom.llm.repeats import Spec, covered, keyed, merged, with_repeats
from graphloom.llm.suffix_array import suffix_array

WINDOW, SEED_BYTES = 100, 24
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def byte_values(text: bytes) -> np.ndarray:
    return _VALUES[np.frombuffer(text, np.uint8)]


def cut_out(text: bytes, at: list[tuple[int, int]]) -> list[bytes]:
    return [text[p : p + n] for p, n in at]


def spec(window: int = WINDOW) -> Spec:
    return Spec(
        window=window, k=max(1, window * SEED_BYTES // WINDOW), values=byte_values, within=True, cut_out=cut_out,
        in_block=lambda rows: repeats_in_block(rows, window),
    )


def repeats_in_block(rows: list[tuple], window: int) -> list[tuple]:
    """Repeats among contexts (id, dk, place, n, context): n windows start at place, all inside the context."""
    raw = b"".join(r[4] for r in rows)
    ids, dks, places, counts = (np.array([r[k] for r in rows], np.int64) for k in range(4))
    ends = np.cumsum([len(r[4]) for r in rows])
    starts = np.append(0, ends[:-1])
    begins = np.zeros(len(raw), bool)
    begins[ranges_to_index(starts, counts)] = True
    order = np.array(suffix_array(raw), np.int64)
    order = order[begins[order]]
    heads = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), window)
    same = np.zeros(len(order), bool)
    for lo in range(1, len(order), 4096):
        hi = min(lo + 4096, len(order))
        same[lo:hi] = (heads[order[lo:hi]] == heads[order[lo - 1 : hi - 1]]).all(1)
    group = np.cumsum(~same)
    owner = np.searchsorted(ends, order, "right")
    i, at = ids[owner], places[owner] + order - starts[owner]
    sort = np.lexsort((at, i, group))
    i, at, dk, group = i[sort], at[sort], dks[owner][sort], group[sort]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))[np.cumsum(np.concatenate([[True], group[1:] != group[:-1]])) - 1]
    later = (i > i[first]) | (i == i[first]) & (at > at[first])
    return merged(i[later], dk[later], at[later], window)


def dedup_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    rows = with_repeats(keyed(docs.select(doc_id, text), doc_id, text), text, spec(window))

    def run(batches):
        for b in batches:
            out = []
            for i, t, blobs in zip(b.column("__id").to_pylist(), texts(b.column(text)), b.column("__blobs").to_pylist()):
                gone = covered(blobs, len(t))
                kept = np.frombuffer(t, np.uint8)[~gone].tobytes() if blobs else t
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) and int(gone[0])))
                out.append((None if i == NO_ID else i, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            columns = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", window: int = WINDOW) -> DataFrame:
    """``docs`` with repeats cut out of their texts; rows of which nothing visible is left go.

    What a cut leaves of a multi-byte character is dropped with it. ``n_chars``,
    where there is such a column, is brought up to date in the rows that change.
    All columns are kept, whatever their names: a row travels as one struct.
    """
    names = docs.columns
    rows = whole_rows(docs, doc_id, text)
    rows = with_repeats(keyed(rows, "doc_id", "text"), "text", spec(window)).select("row", "__blobs")

    def run(batches):
        for b in batches:
            columns = dict(zip(names, b.column("row").flatten()))
            data, keep = columns[text].to_pylist(), []
            sizes = columns[n_chars].to_pylist() if n_chars in names else None
            for k, blobs in enumerate(b.column("__blobs").to_pylist()):
                keep.append(True)
                if blobs:
                    raw = data[k].encode()
                    data[k] = np.frombuffer(raw, np.uint8)[~covered(blobs, len(raw))].tobytes().decode("utf-8", "ignore")
                    keep[-1] = bool(data[k].strip())
                    if sizes:
                        sizes[k] = len(data[k])
            columns[text] = pa.array(data, columns[text].type)
            if sizes:
                columns[n_chars] = pa.array(sizes, columns[n_chars].type)
            fields = [pa.field(f.name, columns[f.name].type) for f in b.column("row").type]
            row = pa.StructArray.from_arrays([columns[c] for c in names], fields=fields)
            yield pa.RecordBatch.from_arrays([row], ["row"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(tidy(run), StructType([StructField("row", docs.schema)])).select("row.*")
