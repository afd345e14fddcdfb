"""Token ids of many texts with a tokenizers file, each distinct word encoded once.

A tokenizer that drops white space, lower-cases, and never joins letters with
punctuation (its file says so: ``BY_WORD``) gives a text the ids of its words in
order. With any other file, whole texts are encoded as they are. Words are split
at ASCII white space and ASCII letters lower-cased where that provably changes
no id, and a closing ASCII punctuation mark is set apart from a letter or digit.
Anything else is the tokenizer's own business. Ids of known words are gathered
with numpy; other new words are encoded together in one call. A worker remembers a bounded number of words and, when it
has too many, keeps those it met first, which are mostly the frequent ones.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from graphloom.llm.common import ranges_to_index

#: Words remembered by one worker, and how many stay when it has more.
KNOWN, KEPT = 350_000, 150_000
TOKENIZER = "word_bpe_49k.json"
#: A word that the tokenizer splits no further: lower-case letters of ASCII and Latin-1 only, or ASCII punctuation (no apostrophe) only.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[!-&(-/:-@\[-`{-~]+")
#: Classes of bytes: ASCII letters and digits 1, ASCII punctuation but the apostrophe 2, white space 4.
_CLASS = np.array([1 if chr(b).isalnum() and b < 128 else 2 if 33 <= b <= 126 and b != 39 else 4 if b in b" \t\n\r\v\f" else 0 for b in range(256)], np.uint8)
#: Stands between other words in one call; a control character that is a token of its own.
MARK = b"\x01"


# The normaliser and pre-tokenizer, as in the tokenizer's file, for which texts may be taken word by word.
BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def special(word: bytes) -> bool:
    """Whether a special token may be in it, or a combining mark that composes with an ASCII character (lead bytes CC and CD)."""
    return b"<|" in word or b"\xcc" in word or b"\xcd" in word


class Encoder:
    def __init__(self, path: str = TOKENIZER, known: int = KNOWN, kept: int = KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        if not os.path.exists(path):
            import public_tokenizers

            path = public_tokenizers.path(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.by_word = all(told.get(k) == v for k, v in BY_WORD.items())
        self.tokenizer, self.known, self.kept = Tokenizer.from_file(path), known, kept
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.wide = len(vocabulary) > 1 << 16
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        mark = self._ids([MARK])[0]
        self.mark = mark[0] if len(mark) == 1 else None
        #: The same model for plain words: they need no normalising, and splitting at white space is enough.
        self.plain = Tokenizer(self.tokenizer.model) if self.ends.any() else None
        if self.plain:
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.number: dict[bytes, int] = {}
        self.sizes = np.zeros(0, np.int64)
        self.begin = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _forget(self) -> None:
        self.number = dict(zip(list(self.number)[: self.kept], range(self.kept)))
        n = len(self.number)
        self.flat = self.flat[: int(self.begin[n - 1] + self.sizes[n - 1]) if n else 0].copy()
        self.sizes, self.begin = self.sizes[:n].copy(), self.begin[:n].copy()

    def _ids(self, texts: list[bytes], tokenizer=None) -> list[np.ndarray]:
        found = (tokenizer or self.tokenizer).encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, np.int64) for e in found]

    def _add(self, words: list[bytes], flat: list[np.ndarray], sizes: np.ndarray) -> None:
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words))))
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, *(f.astype(np.uint32) for f in flat)])

    def _learn(self, words: list[bytes]) -> None:
        """Encode words that are not known: plain ones together, others with marks between, special ones alone."""
        if not words:
            return
        kinds: dict[str, list[bytes]] = {"plain": [], "marked": [], "alone": []}
        for w in words:
            if self.plain and PLAIN.fullmatch(w):
                kinds["plain"].append(w)
            else:
                kinds["alone" if self.mark is None or MARK in w or special(w) else "marked"].append(w)
        parts = lambda x: [x[lo : lo + 500] for lo in range(0, len(x), 500)]
        flat, sizes = [], []
        for ids in self._ids([b" ".join(p) for p in parts(kinds["plain"])], self.plain):
            flat.append(ids)
            sizes.append(np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0))
        gap = b" " + MARK
        for ids in self._ids([(gap + b" ").join(p) + gap for p in parts(kinds["marked"])]):
            flat.append(ids[ids != self.mark])
            sizes.append(np.diff(np.flatnonzero(ids == self.mark), prepend=-1) - 1)
        for ids in self._ids(kinds["alone"]):
            flat.append(ids)
            sizes.append(np.array([len(ids)]))
        self._add([w for x in kinds.values() for w in x], flat, np.concatenate(sizes).astype(np.int64))

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and how many each text has."""
        if not self.by_word:
            ids = self._ids(texts) if texts else []
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            return (np.concatenate(ids) if ids else np.zeros(0, np.int64)).astype(np.uint32), sizes
        odd = [i for i, t in enumerate(texts) if special(t)]
        if odd:
            texts = [t if special(t) else t.lower() for t in texts]
        joined = b"\n".join([*texts, b""])
        raw = np.frombuffer(joined if odd else joined.lower(), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        kind = _CLASS[raw]
        closing = np.flatnonzero((kind[1:-1] == 2) & (kind[:-2] == 1) & (kind[2:] == 4)) + 1
        if odd:
            closing = closing[~np.isin(np.searchsorted(offsets, closing, "right") - 1, odd)]
        raw = np.insert(raw, closing, 32)
        offsets = offsets + np.searchsorted(closing, offsets)
        split = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(raw)))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.large_binary()).to_pylist()
        if len(self.number) > self.known:
            self._forget()
        new = set(words).difference(self.number)
        new.discard(b"")
        self._learn(sorted(new))
        number = np.fromiter((self.number.get(w, -1) for w in words), np.int64, len(words))  # -1: nothing, beside other white space
        at = number[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
        size, begin = np.append(self.sizes, 0)[at], np.append(self.begin, 0)[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.flat[ranges_to_index(begin, size)], np.diff(ends[split.offsets.to_numpy()])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str = TOKENIZER) -> Encoder:
    """The worker's encoder of that file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with id ``end`` after each text."""
    at = np.cumsum(sizes)
    return np.insert(ids, at, np.uint32(end)), sizes + 1
