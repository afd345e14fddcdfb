"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Both tokenizers cut the same bytes. The union of their token ends cuts them into
elementary intervals, each inside one token of A and one of B, found by searching
the interval's end among the ends of each side: an interval is one overlap. An
end that both share closes a group. Links are the token pairs that the contract
of the caller asks for: ``ends`` pairs that end together, ``overlap`` every
elementary interval's pair, ``group`` all pairs of a group.

Texts are cut before each single space or line feed between two visible
characters. A's pre-tokenizer starts a new piece there, and no piece of B holds a
space (as U+2581) after anything else or a line feed at all (checked on the
vocabulary), so both tokenizers give the text the tokens of its cuts, one after
the other, and no group spans a cut. A worker encodes and aligns each distinct cut once
and remembers a bounded number; texts of other tokenizers are one cut each.

Counts of id pairs are summed over the corpus. What a document links is written
once, against a list of the pairs of its batch (a batch is one task's next few
megabytes), and that list, not the documents, is joined with the counts.

* Null and empty texts, and texts whose tokens' bytes are not the text's (such as
  those holding U+2581), have no tokens: zeros and an empty string.
* Repeated rows and rows without an id are rows like others.
* A text of any length is whole in one task, as a value of a row must be.
* Empty documents give no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import BATCH_BYTES, chunks, cut, ranges_to_index, small_batches, tidy

BYTES_FILE, PIECES_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Distinct cuts remembered by one worker, and bytes of those.
KNOWN, KNOWN_BYTES = 200_000, 16 << 20
#: Cuts learned at once, and encoded as one text.
LEARN, TOGETHER = 8192, 512
#: Before a single space or line feed between visible characters.
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Runs of white space, or white space that is neither space nor line feed.
ODD = re.compile(r"\s\s|[^\S \n]")
LINKS = ("ends", "overlap", "group")


def byte_values() -> dict[str, int]:
    """Which byte each character of a byte-level vocabulary stands for: printable ones themselves, the others 256 upwards."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def intervals(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owners in A and in B of each elementary interval, and whether it closes a group. ``a``, ``b``: token ends, ascending, over the same bytes."""
    ends = np.union1d(a, b)
    of_a, of_b = np.searchsorted(a, ends), np.searchsorted(b, ends)
    return of_a, of_b, (a[of_a] == ends) & (b[of_b] == ends)


def linked(of_a: np.ndarray, of_b: np.ndarray, closes: np.ndarray, how: str) -> tuple[np.ndarray, np.ndarray]:
    """Token positions in A and B of every link."""
    if how == "ends":
        return of_a[closes], of_b[closes]
    if how == "overlap":
        return of_a, of_b
    last_a, last_b = of_a[closes], of_b[closes]
    n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    size = n_a * n_b
    within = ranges_to_index(np.zeros(len(size), np.int64), size)
    wide = np.repeat(n_b, size)
    return np.repeat(last_a - n_a + 1, size) + within // wide, np.repeat(last_b - n_b + 1, size) + within % wide


class Aligner:
    """Tokens and links of texts; the same for all tasks of a worker."""

    def __init__(self, a: str = BYTES_FILE, b: str = PIECES_FILE, links: str = "ends", known: int = KNOWN):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        if links not in LINKS:
            raise ValueError(f"links must be one of {LINKS}")
        place = lambda f: f if os.path.exists(f) else public_tokenizers.path(f)
        self.a = Tokenizer.from_file(place(a))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=place(b))
        values = byte_values()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(values[c] for c in token) if all(c in values for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.mark = self.b.piece_to_id("▁")
        self.signs = [f"{i}{c}" for t, signs in ((self.bytes_a, ",|"), (self.bytes_b, ",;")) for i in range(len(t)) for c in signs]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        plain = "ByteLevel(add_prefix_space=False" in str(self.a.pre_tokenizer) and "use_regex=True" in str(self.a.pre_tokenizer) and self.a.normalizer is None
        self.by_cut = plain and not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        self.links, self.known = links, known
        self.number = {}
        self.forget()

    def forget(self, kept: int = 0) -> None:
        """Keep the cuts met first, which are mostly the frequent ones."""
        self.number: dict[str, int] = dict(zip(islice(self.number, kept), range(kept)))
        n = len(self.number)
        self.held = sum(map(len, self.number))
        #: Of each known cut: its groups as text, each with a semicolon after it; tokens of A and B, groups, links; the links' pairs one after the other.
        self.told: list[str] = self.told[:n] if n else []
        self.counts = self.counts[:n].copy() if n else np.zeros((0, 4), np.int64)
        self.begin = self.begin[:n].copy() if n else np.zeros(0, np.int64)
        self.pairs = self.pairs[: int(self.begin[-1] + self.counts[-1, 3])].copy() if n else np.zeros(0, np.int64)

    def cuts(self, text: str) -> list[str]:
        """The cuts of space + text."""
        if not self.by_cut:
            return [" " + text]
        if ODD.search(text) or text[0] in " \n" or text[-1] in " \n":
            return CUT.split(" " + text)
        out = text.replace("\n", " \n").split(" ")
        return [x if x[0] == "\n" else " " + x for x in out]

    def _ids_b(self, surfaces: list[str]) -> list[list[int]]:
        """The mark that B sets before a text stands for a leading space; before a line feed it goes."""
        found = self.b.encode([s[1:] if s[0] == " " else s for s in surfaces], num_threads=1)
        return [i[1:] if s[0] == "\n" and i[:1] == [self.mark] else i for s, i in zip(surfaces, found, strict=True)]

    def _tokens(self, surfaces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of A, all of B, and which cuts keep their bytes; those that don't have none."""
        ids_a, ids_b = ([e.ids for e in self.a.encode_batch_fast(surfaces, add_special_tokens=False)], self._ids_b(surfaces))
        own = [s.encode() for s in surfaces]
        fine = np.array([b"".join([self.bytes_a[t] for t in x]) == o == b"".join([self.bytes_b[t] for t in y]) for x, y, o in zip(ids_a, ids_b, own, strict=True)], bool)
        flat = lambda ids: np.fromiter(chain.from_iterable(x for x, ok in zip(ids, fine, strict=True) if ok), np.int64)
        return flat(ids_a), flat(ids_b), fine

    def _joined(self, surfaces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for cuts that any text could hold one after the other: encoded as one text, so long as that keeps its bytes."""
        text = "".join(surfaces)
        ids_a, ids_b = self.a.encode(text, add_special_tokens=False).ids, self._ids_b([text])[0]
        own = text.encode()
        if b"".join([self.bytes_a[t] for t in ids_a]) == own == b"".join([self.bytes_b[t] for t in ids_b]):
            return np.array(ids_a, np.int64), np.array(ids_b, np.int64), np.ones(len(surfaces), bool)
        return self._tokens(surfaces)

    def _encode(self, surfaces: list[str]) -> None:
        """Learn cuts: their ends joined into one long line of bytes, aligned at once."""
        whole = [self.by_cut and len(s) > 1 and not s[1].isspace() and not s[-1].isspace() and "▁" not in s for s in surfaces]
        plain, other = [s for s, w in zip(surfaces, whole, strict=True) if w], [s for s, w in zip(surfaces, whole, strict=True) if not w]
        surfaces = plain + other
        found = [self._joined(plain[lo : lo + TOGETHER]) for lo in range(0, len(plain), TOGETHER)] + ([self._tokens(other)] if other else [])
        flat_a, flat_b, fine = (np.concatenate(x) for x in zip(*found, strict=True))
        ends_a, ends_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        ends = np.cumsum(np.where(fine, np.fromiter((len(s.encode()) for s in surfaces), np.int64, len(surfaces)), 0))
        of_a, of_b, closes = intervals(ends_a, ends_b)
        link_a, link_b = linked(of_a, of_b, closes, self.links)
        word_a, word_b = (np.searchsorted(ends, e) for e in (ends_a, ends_b))  # the first cut that reaches the token's end: never one without bytes
        n_a, n_b = (np.bincount(w, minlength=len(surfaces)) for w in (word_a, word_b))
        n_links = np.bincount(word_a[link_a], minlength=len(surfaces))
        n_groups = np.bincount(word_a[of_a[closes]], minlength=len(surfaces))
        # tokens in the order of the groups' text: A's of a group, then B's; each with the sign after it
        last_a, last_b = (np.zeros(len(x), bool) for x in (flat_a, flat_b))
        last_a[of_a[closes]] = last_b[of_b[closes]] = True
        group_a, group_b = (np.cumsum(x) - x for x in (last_a, last_b))
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        code = np.concatenate([2 * flat_a + last_a, 2 * len(self.bytes_a) + 2 * flat_b + last_b])[order]
        text = [self.signs[c] for c in code.tolist()]
        told_to = np.cumsum(n_a + n_b)
        self.told += ["".join(text[hi - n : hi]) for hi, n in zip(told_to.tolist(), (n_a + n_b).tolist(), strict=True)]
        counts = np.stack([np.where(fine, n_a, -1), n_b, n_groups, n_links], axis=1)
        self.begin = np.concatenate([self.begin, len(self.pairs) + np.cumsum(n_links) - n_links])
        self.counts, self.pairs = np.concatenate([self.counts, counts]), np.concatenate([self.pairs, flat_a[link_a] << 32 | flat_b[link_b]])
        self.number.update(zip(surfaces, range(len(self.number), len(self.number) + len(surfaces)), strict=True))
        self.held += sum(map(len, surfaces))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Of each text: n_a, n_b, n_groups, n_links; the digest; and (text, pair) of every link, pairs as A's id times 2^32 plus B's."""
        if len(self.number) > self.known:
            self.forget(self.known // 2)
        if self.held > KNOWN_BYTES:
            self.forget()
        parts = [self.cuts(t) if t else [] for t in texts]
        new = sorted(set(chain.from_iterable(parts)).difference(self.number))
        for lo in range(0, len(new), LEARN):
            self._encode(new[lo : lo + LEARN])
        number = self.number
        numbers = [[number[c] for c in p] for p in parts]
        sizes = np.array([len(p) for p in parts], np.int64)
        at = np.fromiter(chain.from_iterable(numbers), np.int64, int(sizes.sum()))
        of = np.repeat(np.arange(len(texts)), sizes)
        broken = np.unique(of[self.counts[at, 0] < 0]) if len(at) else np.zeros(0, np.int64)
        keep = ~np.isin(of, broken)
        at, of = at[keep], of[keep]
        totals = np.stack([np.bincount(of, self.counts[at, i], len(texts)) for i in range(4)], axis=1).astype(np.int64) if len(texts) else np.zeros((0, 4), np.int64)
        bad = set(broken.tolist())
        told = self.told
        digests = ["" if not p or i in bad else hashlib.sha256("".join([told[n] for n in p])[:-1].encode()).hexdigest() for i, p in enumerate(numbers)]
        n = self.counts[at, 3] if len(at) else np.zeros(0, np.int64)
        return totals, digests, np.repeat(of, n), self.pairs[ranges_to_index(self.begin[at], n)]


_ALIGNERS: dict[tuple, Aligner] = {}


def aligner(*key) -> Aligner:
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(*key)
    return _ALIGNERS[key]


TOLD = "batch long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair array<int>, times array<int>, ids_a array<int>, ids_b array<int>, n array<long>"


def aligned(docs: DataFrame, a: str = BYTES_FILE, b: str = PIECES_FILE, links: str = "ends") -> DataFrame:
    """A row a document, its links as numbers of its batch's pairs, and a row a batch with these pairs' ids and counts (``n`` not null)."""

    def run(batches):
        both = aligner(a, b, links)
        number = TaskContext.get().partitionId() << 32
        for rows in batches:
            ids, texts = rows.column(0), rows.column(1).to_pylist()
            sizes = np.fromiter((len(t or "") for t in texts), np.int64, len(texts))
            for lo, hi in chunks(sizes, BATCH_BYTES // 2):
                totals, digests, of, key = both(texts[lo:hi])
                pairs, place = np.unique(key, return_inverse=True)
                each, times = np.unique(of * len(pairs) + place, return_counts=True)
                owner = each // max(len(pairs), 1)
                starts = np.searchsorted(owner, np.arange(hi - lo + 1)).astype(np.int32)
                lists = lambda v, starts=starts: pa.ListArray.from_arrays(pa.array(starts), pa.array(v.astype(np.int32)))
                m, null = hi - lo, pa.nulls
                columns = [pa.array(np.full(m, number)), ids[lo:hi], *(pa.array(totals[:, i]) for i in range(4)), pa.array(digests, pa.string())]
                columns += [lists(each % max(len(pairs), 1)), lists(times), null(m, pa.list_(pa.int32())), null(m, pa.list_(pa.int32())), null(m, pa.list_(pa.int64()))]
                names = [c.split()[0] for c in TOLD.split(", ")]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                if len(pairs):
                    one = [pa.array([number]), *(null(1, pa.int64()) for _ in range(5)), null(1, pa.string()), *(null(1, pa.list_(pa.int32())) for _ in range(2))]
                    one += [pa.array([x.tolist()], pa.list_(t)) for x, t in ((pairs >> 32, pa.int32()), (pairs & 0xFFFFFFFF, pa.int32()), (np.bincount(place), pa.int64()))]
                    yield pa.RecordBatch.from_arrays(one, names=names)
                number += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(tidy(run), TOLD)


def score(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Of one batch: n_best and count_sum of each document, from the counts of the batch's pairs."""
    number = np.asarray(pairs.column("number").combine_chunks())
    count, best = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
    count[number] = np.asarray(pairs.column("count").combine_chunks())
    best[number] = np.asarray(pairs.column("best").combine_chunks().cast(pa.int64()))
    pair, times = (docs.column(c).combine_chunks() for c in ("pair", "times"))
    sizes = np.asarray(pair.value_lengths().fill_null(0)).astype(np.int64)
    at, n = np.asarray(pair.flatten()), np.asarray(times.flatten()).astype(np.int64)
    ends = np.cumsum(sizes)
    total = lambda v: (lambda s: s[ends] - s[ends - sizes])(np.concatenate([[0], np.cumsum(v * n)]))
    found = {"n_best": total(best[at]), "count_sum": total(count[at])} if len(number) else {c: np.zeros(docs.num_rows, np.int64) for c in ("n_best", "count_sum")}
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    for name, v in found.items():
        out = out.append_column(name, pa.array(v, pa.int64()))
    return out.append_column("groups_sha256", docs.column("groups_sha256"))


def pair_counts(told: DataFrame) -> DataFrame:
    """a, b, count, best: every linked id pair of the corpus, and whether no other id of A is linked with b more often."""
    each = told.where(F.col("n").isNotNull()).select(F.inline(F.arrays_zip(F.col("ids_a").alias("a"), F.col("ids_b").alias("b"), F.col("n").alias("n"))))
    counts = each.groupBy("a", "b").agg(F.sum("n").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def align(docs: DataFrame, a: str = BYTES_FILE, b: str = PIECES_FILE, links: str = "ends") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    small_batches(docs.sparkSession)
    told = cut(aligned(docs, a, b, links), "aligned")
    lists = told.where(F.col("n").isNotNull()).select(F.col("batch").alias("of"), F.posexplode(F.arrays_zip(F.col("ids_a").alias("a"), F.col("ids_b").alias("b"))).alias("number", "p"))
    known = lists.select("of", "number", "p.a", "p.b").join(pair_counts(told), ["a", "b"]).select("of", "number", "count", "best")
    rows = told.where(F.col("n").isNull()).drop("ids_a", "ids_b", "n")
    return rows.groupBy("batch").cogroup(known.groupBy("of")).applyInArrow(score, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
