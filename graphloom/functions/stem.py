"""The Porter stemmer (1980) as a column function; each distinct word is stemmed once a worker."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# The published suffixes and what they become, by step; the longest match counts.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

#: Words a worker remembers.
KNOWN = 200_000


def shape(word: str) -> str:
    """Each letter as c or v; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def measure(stem: str) -> int:
    """How often a consonant follows a vowel."""
    return len(re.findall("v+c", shape(stem)))


def _short_end(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return shape(word).endswith("cvc") and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def stem(word: str) -> str:
    if len(word) < 3:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if measure(word[:-3]):
            word = word[:-1]
    else:
        end = "ed" if word.endswith("ed") else "ing" if word.endswith("ing") else ""
        if end and "v" in shape(word[: -len(end)]):
            word = word[: -len(end)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif measure(word) == 1 and _short_end(word):
                word += "e"
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP2, STEP3):
        if (s := _longest(word, table)) and measure(word[: -len(s)]):
            word = word[: -len(s)] + table[s]
    if s := _longest(word, STEP4):
        rest = word[: -len(s)]
        if measure(rest) > 1 and (s != "ion" or rest.endswith(("s", "t"))):
            word = rest
    if word.endswith("e") and (measure(word[:-1]) > 1 or (measure(word[:-1]) == 1 and not _short_end(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word


@F.pandas_udf(ArrayType(StringType()))
def _stems(words: pd.Series) -> pd.Series:
    known: dict[str, str] = _REMEMBERED
    out = []
    for row in words:
        if len(known) > KNOWN:
            known.clear()
        out.append([known[w] if w in known else known.setdefault(w, stem(w) if w.isascii() and w.isalpha() else w) for w in (row if row is not None else ())])
    return pd.Series(out)


_REMEMBERED: dict[str, str] = {}


def stems(words: Column) -> Column:
    """Stems of an array of lower-case words; words that are not plain letters stay as they are."""
    return _stems(words)
