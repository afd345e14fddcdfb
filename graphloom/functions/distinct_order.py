"""The order in which the SQL's ``list_distinct`` yields a list, and sums taken in that order.

A sum of doubles depends on its order in the last digits. DuckDB (2.0.0, Linux) keeps a
list's distinct values in libstdc++'s ``unordered_map``: buckets by a hash of the bytes, a
new bucket before all others, a new value first in its bucket, and twice the buckets when
there are as many values as buckets.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

# Sizes a libstdc++ table grows through.
BUCKETS = [13, 29, 59, 127, 257, 541, 1109, 2357, 5087, 10273, 20753, 42043, 85229, 172933, 351061, 712697, 1447153, 2938679]
WORD, MIX, SEED, LENGTH = (1 << 64) - 1, 0xD6E8FEB86659FD93, 0xE17A1465, 0xC6A4A7935BD1E995
#: Weight of a token that only one of two lines has, as the SQL writes it.
ALONE = math.log(1.5) + 1


@lru_cache(1 << 16)
def hashed(value: str) -> int:
    """DuckDB's hash of a string."""
    data = value.encode()
    h = SEED ^ (len(data) * LENGTH & WORD)
    for i in range(0, len(data), 8):
        h = (h ^ int.from_bytes(data[i : i + 8], "little")) * MIX & WORD
    h = (h ^ (h >> 32)) * MIX & WORD
    h = (h ^ (h >> 32)) * MIX & WORD
    return h ^ (h >> 32)


def list_distinct(values: list[str]) -> list[str]:
    """The distinct values in the order of the SQL's ``list_distinct``."""
    new, order = list(dict.fromkeys(values)), []
    for n in BUCKETS:
        buckets: dict[int, list[str]] = {}
        for v in order + new[len(order) : n]:
            buckets.setdefault(hashed(v) % n, []).append(v)
        order = [v for b in reversed(buckets.values()) for v in reversed(b)]
        if len(order) == len(new):
            return order
    raise ValueError(f"more than {BUCKETS[-1]} distinct values")


def tfidf_cosine(a: list[str], b: list[str]) -> float:
    """The cosine of ``text.pair_tfidf_cosine``, with the SQL's order of additions."""
    na, nb = Counter(a), Counter(b)
    dot = left = right = 0.0
    for t in list_distinct(a + b):
        w = 1.0 if t in na and t in nb else ALONE
        x, y = na[t] * w, nb[t] * w
        dot, left, right = dot + x * y, left + x * x, right + y * y
    return dot / ((math.sqrt(left) + 1e-9) * (math.sqrt(right) + 1e-9)) if na or nb else 0.0
