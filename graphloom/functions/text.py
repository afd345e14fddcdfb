"""Text functions as column expressions: cleaning, splitting, tokens, anchors, similarity, readability.

Everything here is built-in expressions, so it stays inside the JVM; the few
functions that scan sequentially live in ``sequential``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words left out of content tokens.
STOPWORDS = """
a an the and or for of in on at to from by with as is are was were be been being
that this those these it its their his her they them we you i our your not but so
because therefore however though although while when where which who whom whose
into over under without within if then also just very really more most much
""".split()
# Openings that mark a transition between sentences.
TRANSITIONS = [
    "however", "therefore", "meanwhile", "later", "then", "next", "finally", "first", "second", "in contrast", "overall", "in summary", "ultimately", "afterward", "beforehand",
    "subsequently", "additionally", "moreover", "nonetheless", "nevertheless",
]
# Names of months, in order.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


def squeeze(c: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_noise(c: Column) -> Column:
    """Straight quotes, typed literals unwrapped, URLs and tags dropped, white space squeezed; null is empty."""
    c = F.translate(F.coalesce(c, F.lit("")), "“”’", "\"\"'")
    c = F.regexp_replace(c, r'^\s*"\s*([^"]*?)\s*\^\^.*$', "$1")
    return squeeze(F.regexp_replace(c, r"https?://\S+|<[^>]+>", ""))


def sentences(c: Column, style: str = "A") -> Column:
    """Sentences of a text.

    A: after ``.!?`` and white space. B: also at line breaks. C: only where an
    upper-case letter or digit follows. D: like C, without sentences under three words.
    """
    text = F.coalesce(c, F.lit(""))
    if style == "A":
        parts = F.split(F.trim(text), r"(?<=[.!?])\s+")
    elif style == "B":
        parts = F.split(text, r"(?<=[.?!])\s+|\n+")
    else:
        parts = F.split(squeeze(text), r"""(?<=[.!?])\s+(?=(?:["“”')]*\s*)?[A-Z0-9])""")
    out = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    return F.filter(out, lambda x: F.size(F.split(x, " ")) >= 3) if style == "D" else out


def tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and apostrophes."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9']+"), 0)


def content_tokens(c: Column) -> Column:
    """Lower-case words of two letters or more that are no function words."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[A-Za-z][A-Za-z\-']+"), 0)
    return F.filter(F.transform(found, lambda x: F.lower(x)), lambda x: ~x.isin(STOPWORDS))


def proper_nouns(c: Column) -> Column:
    """Runs of one to four capitalised words; a letter of any script next to them is part of a word."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?U)\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3})\b"), 0)


def numbers(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?U)\b[0-9][0-9,\.]*\b"), 0)


def years(c: Column, compat: bool = False) -> Column:
    """Years from 1900 to 2099; ``compat`` gives their centuries only, as an older evaluation did."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?U)\b(19|20)[0-9]{2}\b"), 1 if compat else 0)


def normalise_dates(c: Column) -> Column:
    """Appends the ISO form to dates such as ``13 July 1985`` and ``July 13, 1985``."""
    for i, m in enumerate(MONTHS, 1):
        for day in ("(0?[1-9])", "([12][0-9]|3[01])"):
            pad = "0" if day.startswith("(0") else ""
            short = day.replace("(0?", "0?(")
            c = F.regexp_replace(c, rf"(?i)\b{short}\s+({m})\s+(\d{{4}})\b", f"$0 $3-{i:02d}-{pad}$1")
            c = F.regexp_replace(c, rf"(?i)\b({m})\s+{short},?\s+(\d{{4}})\b(?!-)", f"$0 $3-{i:02d}-{pad}$2")
    return c


def expand_aliases(c: Column, aliases: dict[str, list[str]]) -> Column:
    """Each variant, as a whole word and in any case, becomes ``canonical variant``; variants apply in order."""
    for canonical, variants in aliases.items():
        for v in variants:
            c = F.regexp_replace(c, rf"(?i)\b{_quote(v)}\b", f"{canonical} {v}")
    return c


def _quote(s: str) -> str:
    return "".join(ch if ch.isalnum() or ch == " " else "\\" + ch for ch in s)


# --- similarity ---


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Shared over all distinct elements; ``empty`` where neither has any."""
    both, all_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(all_ == 0, F.lit(empty)).otherwise(both / all_)


def _windows(c: Column, n: int, pad: bool) -> Column:
    t = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    t = F.concat(F.lit(" "), t, F.lit(" ")) if pad else t
    return F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))."), 1)  # looks ahead from every character


def char_grams(c: Column, n: int = 3, pad: bool = True) -> Column:
    """Distinct character n-grams of the lower-case text, with a space at either end where ``pad``; linear in its length."""
    return F.array_distinct(_windows(c, n, pad))


def gram_hashes(c: Column, n: int = 3, pad: bool = True) -> Column:
    """``char_grams`` as hashes of 64 bits, which intersect without boxing."""
    return F.array_distinct(F.transform(_windows(c, n, pad), lambda x: F.xxhash64(x)))


def count_map(toks: Column) -> Column:
    """Array of struct<t, n>: how often each token occurs."""
    return F.transform(F.array_distinct(toks), lambda t: F.struct(t.alias("t"), F.size(F.filter(toks, lambda x: x == t)).alias("n")))


def pair_tfidf_cosine(a: Column, b: Column) -> Column:
    """Cosine of raw-count TF-IDF vectors whose corpus is just the two token arrays.

    A term of both weighs 1 a count, a term of one ln(3/2) + 1.
    """
    one = math.log(1.5) + 1
    add = lambda arr, f: F.aggregate(arr, F.lit(0.0), lambda s, x: s + f(x))
    n_in = lambda toks, t: F.size(F.filter(toks, lambda x: x == t)).cast("double")
    shared = F.array_intersect(a, b)
    dot = add(shared, lambda t: n_in(a, t) * n_in(b, t))

    def norm(x: Column, y: Column) -> Column:
        both = add(shared, lambda t: n_in(x, t) * n_in(x, t))
        own = add(F.array_except(x, y), lambda t: n_in(x, t) * n_in(x, t))
        return F.sqrt(both + own * (one * one)) + 1e-9

    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(0.0)).otherwise(dot / (norm(a, b) * norm(b, a)))


def contains_ngram(a: Column, b: Column, n: int) -> Column:
    """Whether the token arrays share a run of n tokens (of the shorter one's length, if less)."""
    grams = lambda x, k: F.transform(F.sequence(F.lit(1), F.greatest(F.size(x) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(x, i, k), " "))
    k = F.least(F.lit(n), F.size(a), F.size(b))
    return F.when(k < 1, F.lit(False)).otherwise(F.arrays_overlap(grams(a, k), grams(b, k)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def topic_similarity(a: Column, b: Column) -> Column:
    """One minus the Jensen-Shannon divergence of two distributions, in units of ln 2."""
    eps = 1e-12
    mid = F.zip_with(a, b, lambda x, y: (x + y) / 2)
    kl = lambda p: F.aggregate(F.zip_with(p, mid, lambda x, m: x * F.log((x + eps) / (m + eps))), F.lit(0.0), lambda s, x: s + x)
    return 1 - (kl(a) + kl(b)) / 2 / math.log(2)


# --- readability ---


def syllables(word: Column) -> Column:
    """Groups of vowels, a silent closing e not counted; one at least, none without letters."""
    w = F.regexp_replace(F.lower(word), "[^a-z]", "")
    groups = F.size(F.regexp_extract_all(w, F.lit("[aeiouy]+"), 0))
    n = F.when(F.endswith(w, F.lit("e")) & (groups > 1), groups - 1).otherwise(groups)
    return F.when(w == "", F.lit(0)).otherwise(F.greatest(n, F.lit(1)))


def flesch(n_sentences: Column, n_words: Column, n_syllables: Column) -> Column:
    score = 206.835 - 1.015 * (n_words / n_sentences) - 84.6 * (n_syllables / n_words)
    return F.when((n_sentences == 0) | (n_words == 0), F.lit(0.0)).otherwise(score)


def grade(n_sentences: Column, n_words: Column, n_syllables: Column) -> Column:
    score = 0.39 * (n_words / n_sentences) + 11.8 * (n_syllables / n_words) - 15.59
    return F.when((n_sentences == 0) | (n_words == 0), F.lit(0.0)).otherwise(score)


def lemma(word: Column) -> Column:
    """A light stem: possessive, -ing, -ed, -es and -s taken off words long enough."""
    w = F.regexp_replace(F.lower(word), "'s$", "")
    n = F.char_length(w)
    drop = lambda k: F.substring(w, F.lit(1), n - k)
    return F.when(w.endswith("ing") & (n > 5), drop(3)).when(w.endswith("ed") & (n > 4), drop(2)).when(w.endswith("es") & (n > 4), drop(2)).when(w.endswith("s") & (n > 3), drop(1)).otherwise(w)


def linear_map(x: Column, low: float, high: float) -> Column:
    """0 at ``low``, 100 at ``high``, clamped; ``low`` may be the larger one."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100.0 * (x - low) / (high - low)))


def three_way(x: Column, green: float, amber: float, higher: bool = True) -> Column:
    good = (x >= green) if higher else (x <= green)
    fair = (x >= amber) if higher else (x <= amber)
    return F.when(good, "green").when(fair, "amber").otherwise("red")


# --- pieces of text ---


def fixed_chunks(c: Column, size: int, overlap: int = 0) -> Column:
    """Chunks of ``size`` characters, each ``overlap`` into the one before; the last reaches the end."""
    step, n = max(1, size - overlap), F.char_length(c)
    count = F.when(n == 0, 0).when(n <= size, 1).otherwise(1 + F.ceil((n - size) / step)).cast("int")
    return F.when(count == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.substring(c, i * step + 1, F.lit(size))))


def factlet(*parts: Column, limit: int = 280) -> Column:
    """Fields joined by dashes without URLs, cut at a word before ``limit`` characters."""
    text = squeeze(F.concat_ws(" — ", *(F.when(~p.rlike("^https?://"), p) for p in parts)))
    cut = F.regexp_replace(F.substring(text, 1, limit), r"\s+\S*$", "")
    return F.when(F.char_length(text) <= limit, text).otherwise(cut)


def citations(c: Column) -> Column:
    """Ids cited as ``[CQ-...]`` or ``[n]``."""
    return F.regexp_extract_all(c, F.lit(r"\[((?:CQ-[A-Za-z0-9.]+)|\d+)\]"), 1)
