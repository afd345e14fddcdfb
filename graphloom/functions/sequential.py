"""Text functions that scan from left to right, as Arrow-batched Pandas UDFs."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

# Words of numbers.
UNITS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
TENS = {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
SCALES = {"thousand": 10**3, "million": 10**6, "billion": 10**9}


def phrase_value(words: list[str]) -> int | None:
    """The number that a whole phrase names, or None."""
    total = current = 0
    seen = False
    for w in words:
        if w in UNITS or w in TENS:
            current += UNITS.get(w, TENS.get(w, 0))
            seen = True
        elif w == "hundred" and seen:
            current = max(current, 1) * 100
        elif w in SCALES and seen:
            total, current = total + max(current, 1) * SCALES[w], 0
        elif w != "and" or not seen:
            return None
    return total + current if seen else None


def spell_out(text: str, longest: int = 5) -> str:
    """Appends the value after phrases of two to ``longest`` number words, the longest first."""
    parts = re.split(r"(\s+)", text)
    words = [re.sub(r"[^a-z]", "", p.lower()) for p in parts]
    out, i = [], 0
    while i < len(parts):
        for n in range(longest, 1, -1):
            j = i + 2 * n - 1
            if j <= len(parts) and (words[i] in UNITS or words[i] in TENS) and words[j - 1] != "and" and (v := phrase_value(words[i:j:2])) is not None:
                out += parts[i:j] + [f" {v}"]
                i = j
                break
        else:
            out.append(parts[i])
            i += 1
    return "".join(out)


@F.pandas_udf(StringType())
def normalise_spelled_numbers(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else spell_out(t))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two strings."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def drop_near(lines: list[str], threshold: float) -> list[str]:
    """Keeps a line if its token Jaccard with every line kept so far is below the threshold."""
    kept: list[tuple[str, set[str]]] = []
    for line in lines:
        t = set(re.findall(r"[a-z0-9']+", line.lower()))
        if all(len(t & k) / len(t | k) < threshold if t | k else False for _, k in kept):
            kept.append((line, t))
    return [line for line, _ in kept]


def drop_near_lines(column, threshold: float = 0.85):
    """Greedy near-duplicate removal inside an array of lines, in order; not transitive."""

    @F.pandas_udf(ArrayType(StringType()))
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: None if x is None else drop_near(list(x), threshold))

    return run(column)
