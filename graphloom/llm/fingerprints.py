"""I-Match document fingerprints over randomised sub-lexicons, in DataFrame functions only.

Terms are the words of a text between ASCII white space, hashed. The lexicon
holds the terms whose inverse document frequency lies in a band: those in at
most ``MAX_SHARE`` and at least ``MIN_SHARE`` of all distinct texts (copies of a
text count as one). Both ends are shares, so the band is the same at every size
and holds at most (mean distinct terms of a text) / ``MIN_SHARE`` terms, however
large the corpus. It is kept as a bitmap of ``BITS`` to ``2 * BITS`` bits a term,
so of the terms outside the band a fixed small share passes as well; which ones
is the same for all texts.

``STREAMS`` times, the lexicon is thinned at random by halves: a stream's l-th
sub-lexicon keeps a random ``1 / 2**l`` of the terms, l = 1, 2, ... as long as any
is left. The sub-lexicons overlap, are the same for all texts, and each
is hashed over all of a document's distinct in-band terms in it, sorted. Large
sub-lexicons tell texts of few terms apart, small ones survive edits of texts of
many.

Likeness: each stream is one observation, its smallest sub-lexicon that holds a
term of either text. The more terms they share, the likelier it is the same in
both; the share of such streams estimates the share of terms in common, and no
single common term counts in more than one stream of an order. Equal fingerprints
have 1.

In-band terms say little of a text that has hardly any among its terms (under
``FEW_SHARE``). Such a text is fingerprinted over all its terms, and two texts of
which either has few are compared over all terms of both.

The neighbour that an edited text borrows from is found without a global sort:
documents are dealt into buckets of consecutive ids, each bucket also gets the
first document of the next, and a window within the bucket does the rest. Rows
without an id are dealt by the hash of their text.

Defined results: a null text is an empty one; the fingerprint shown is that of all
terms where a text has few in band; two texts without words are alike (1.0), a
text with and one without are not (0.0); a missing id sorts below all others,
rows of one id by the hash of their text; a single document is its own
neighbour; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import BROADCAST_BYTES, cut, partitions, release

#: Random orders of the lexicon, paths of halvings in each, and their product.
ORDERS, BRANCHES = 6, 8
STREAMS = ORDERS * BRANCHES
#: Band of document frequency, as shares of all distinct texts.
MAX_SHARE, MIN_SHARE = 0.02, 0.001
#: Bits of the bitmap for each term in the band, at least.
BITS = 8
#: A text with a smaller share of its terms in band has few of them.
FEW_SHARE = 0.25
#: Rows that one bucket of consecutive ids should hold; beyond MAX_BUCKETS buckets they hold more and their sort spills.
BUCKET_ROWS, MAX_BUCKETS = 2000, 20_000
LOWEST = -(1 << 63)


def terms(text: Column) -> Column:
    """Distinct term hashes of a text, in no order that counts."""
    words = F.split(F.translate(text, "\t\n\x0b\f\r", "     "), " ")
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


class Lexicon:
    """The band as a bitmap."""

    def __init__(self, bitmap: list[int]):
        self.bitmap = bitmap
        # one string, which the optimiser folds into one array
        self.table = F.split(F.lit(",".join(map(str, bitmap))), ",").cast("array<bigint>")

    def in_band(self, found: Column) -> Column:
        mask = 64 * len(self.bitmap) - 1

        def has(t: Column) -> Column:
            b = t.bitwiseAND(mask)
            return F.getbit(F.get(self.table, F.shiftright(b, 6).cast("int")), b.bitwiseAND(63).cast("int")) == 1

        return F.filter(found, has)


def lexicon(docs: DataFrame, text: str = "text") -> Lexicon:
    """The band, learnt from all documents."""
    hashed = docs.select(F.coalesce(text, F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    per_text = cut(hashed.groupBy("h").agg(F.count("*").alias("copies")), "texts")
    n, repeated = per_text.agg(F.count("*"), F.count_if(F.col("copies") > 1)).first()
    often = per_text.filter("copies > 1")
    weighed = hashed.join(F.broadcast(often) if repeated * 16 <= BROADCAST_BYTES else often.hint("merge"), "h", "left")
    seen = weighed.select(F.explode(terms(F.col("text"))).alias("t"), (F.lit(1.0) / F.coalesce("copies", F.lit(1))).alias("weight"))
    counts = cut(seen.groupBy("t").agg(F.round(F.sum("weight"), 3).alias("df")), "terms", partitions(docs.sparkSession))
    band = counts.filter((F.col("df") <= max(1.0, n * MAX_SHARE)) & (F.col("df") >= n * MIN_SHARE))
    inside = band.count()
    size = max(6, (BITS * inside - 1).bit_length()) if inside else 6
    place = F.col("t").bitwiseAND((1 << size) - 1)
    words = band.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(t & 63 as int))")).alias("bits"))
    bitmap = [0] * (1 << size - 6)
    for r in words.collect():  # bounded as the band is
        bitmap[r.w] = r.bits
    release(per_text, counts)
    return Lexicon(bitmap)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prints(found: Column) -> Column:
    """For each stream: hashes of the terms in its sub-lexicons, from the largest on, as long as there are any.

    Stream (r, b) follows one path of halvings of the r-th order: its sub-lexicon at
    level 1, 2, 3 holds the terms whose r-th hash begins with the first 1, 2, 3
    bits of b, and every further level halves it again. In the sorted hashes each
    of these is one run; marks sorted in with them tell where the first ones begin.
    """
    eighth = F.lit(1 << 61)
    marks = F.lit([(k << 61) - (1 << 63) for k in range(BRANCHES)]).cast("array<bigint>")

    def digest(run: Column) -> Column:
        return F.xxhash64(run).bitwiseAND(0xFFF).cast("int")

    def order(r: Column) -> Column:
        hashes = F.transform(found, lambda t: F.xxhash64(t, r).bitwiseOR(1))  # odd: never a mark
        return F.sort_array(F.concat(hashes, marks))

    def upper(run: Column, at: Column, width: int) -> Column:
        """The entry of each sub-lexicon that ``width`` branches share."""

        def entry(k: Column) -> Column:
            first = k * width
            n = F.get(at, first + width) - F.get(at, first)
            return F.when(n > width, F.array(digest(F.slice(run, F.get(at, first), n)))).otherwise(F.array().cast("array<int>"))

        return F.transform(F.sequence(F.lit(0), F.lit(BRANCHES // width - 1)), entry)

    def branch(run: Column, at: Column, b: Column, halves: Column, quarters: Column) -> Column:
        def lower(v: Column) -> Column:
            least = F.get(v, F.lit(0)) - F.get(marks, b)
            depth = F.greatest(F.lit(0), 60 - F.floor(F.log2(least.cast("double"))).cast("int"))
            bounds = F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda k: F.get(marks, b) + F.call_function("shiftright", eighth, k))

            def levels(bounds: Column) -> Column:
                # sorted in with the hashes, a level's bound (even: never a hash) tells how many lie below it
                both = F.sort_array(F.concat(v, bounds))
                return _let(both, lambda x: F.transform(bounds, lambda bound, k: digest(F.slice(v, 1, F.array_position(x, bound).cast("int") - F.size(bounds) + k))))

            below = F.when(depth > 0, _let(bounds, levels)).otherwise(F.array().cast("array<int>"))
            return F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(F.concat(F.array(digest(v)), below))

        mine = F.slice(run, F.get(at, b) + 1, F.get(at, b + 1) - F.get(at, b) - 1)
        return F.concat(F.get(halves, F.shiftright(b, 2)), F.get(quarters, F.shiftright(b, 1)), _let(mine, lower))

    def streams(run: Column) -> Column:
        begins = F.concat(F.transform(marks, lambda m: F.array_position(run, m).cast("int")), F.array(F.size(run) + 1))
        every = F.sequence(F.lit(0), F.lit(BRANCHES - 1))
        return _let(begins, lambda at: _let(upper(run, at, 4), lambda h: _let(upper(run, at, 2), lambda q: F.transform(every, lambda b: branch(run, at, b, h, q)))))

    return F.flatten(F.transform(F.transform(F.sequence(F.lit(0), F.lit(ORDERS - 1)), order), streams))


def with_fingerprint(df: DataFrame, text: str, words: Lexicon, name: str) -> DataFrame:
    """``df`` with ``<name>_few``, whether the text has few terms in band, and ``<name>_hashes``, over those or all.

    Plain columns: fields of a struct would be computed again wherever they are read.
    """
    band, whole, few = f"{name}_band", f"{name}_all", f"{name}_few"
    df = df.withColumn(whole, terms(F.col(text)))
    df = df.withColumn(band, words.in_band(F.col(whole)))
    df = df.withColumn(few, F.size(band) < F.size(whole) * FEW_SHARE)
    used = df.withColumn(whole, F.when(F.col(few), F.col(whole)).otherwise(F.col(band)))
    return used.withColumn(f"{name}_hashes", prints(F.col(whole))).drop(band, whole)


def likeness(x: str, x_text: str, y: str, y_text: str) -> Column:
    """Likeness of two texts with columns of ``with_fingerprint``, over the same kind of terms of both; all terms are hashed only where one has few in band and the other has not."""

    def over_all(f: str, text: str) -> Column:
        few, mine = F.col(f"{f}_few"), F.col(f"{f}_hashes")
        return F.when((F.col(f"{x}_few") != F.col(f"{y}_few")) & ~few, _let(terms(F.col(text)), prints)).otherwise(mine)

    # both sides are read several times: each is made once
    return _let(F.struct(over_all(x, x_text).alias("p"), over_all(y, y_text).alias("q")), lambda v: equal_share(v["p"], v["q"]))


def equal_share(p: Column, q: Column) -> Column:
    """From 0 to 1: the estimated share of terms in common, of two arrays of hashes.

    A stream's smallest sub-lexicon that holds a term of either text holds n of
    their terms with probability 1 / (n 2**n ln 2). At a share s in common it is
    the same in both texts with probability -log2(1 - s / 2), whose inverse is
    applied to the share of such streams among those that hold any term.
    """
    told = F.zip_with(p, q, lambda a, b: F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(None)).otherwise((F.size(a) == F.size(b)) & (F.element_at(a, F.lit(-1)) == F.element_at(b, F.lit(-1)))))
    count = lambda t, keep: F.size(F.filter(t, keep))
    share = _let(told, lambda t: count(t, lambda x: x) / F.greatest(F.lit(1), count(t, lambda x: x.isNotNull())))
    return F.when(p == q, F.lit(1.0)).otherwise(2 * (1 - F.pow(F.lit(2.0), -share))).cast("double")


def as_text(name: str) -> Column:
    """The hashes in hexadecimal, stream by stream; ``all:`` before those of all terms."""
    digits = F.split(F.lit(",".join(f"{h:03x}" for h in range(1 << 12))), ",")  # folded into one array
    streams = F.transform(f"{name}_hashes", lambda a: F.array_join(F.transform(a, lambda h: F.get(digits, h)), ""))
    return F.concat(F.when(F.col(f"{name}_few"), F.lit("all:")).otherwise(F.lit("")), F.array_join(streams, ","))


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at most ``key``: a search in two steps."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    coarse = F.size(F.filter(F.lit(bounds[::step]).cast("array<bigint>"), lambda b: b <= key))
    fine = F.slice(F.lit(bounds).cast("array<bigint>"), (coarse - 1) * step + 1, F.lit(step))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * step + F.size(F.filter(fine, lambda b: b <= key)))


def dealt_in_order(rows: DataFrame) -> DataFrame:
    """``rows(__id, __tie, ...)`` with ``__bucket`` of consecutive ids; a copy of each bucket's first row ends the one before."""
    spark = rows.sparkSession
    keys = rows.select("__id", "__tie")
    n = keys.count()
    want = min(MAX_BUCKETS, max(partitions(spark), n // BUCKET_ROWS))
    cuts = [k / want for k in range(1, want)]
    known = keys.filter(F.col("__id") != LOWEST)
    bounds = sorted(set(known.agg(F.percentile_approx("__id", cuts, 10 * want)).first()[0] or [])) if n and cuts else []
    # rows without an id lie below all others, in `want` buckets by hash
    hashed = F.floor(F.col("__tie") / F.lit(2.0**64 / want)).cast("int") - F.lit(want)
    bucket = F.when(F.col("__id") == LOWEST, hashed).otherwise(_bucket(F.col("__id"), bounds))
    dealt = rows.withColumn("__bucket", bucket)
    # the first row of each bucket in descending order: at most 2 * MAX_BUCKETS rows of ids
    heads = keys.withColumn("__bucket", bucket).groupBy("__bucket").agg(F.max(F.struct("__id", "__tie")).alias("h"))
    firsts = sorted(((r["__bucket"], r.h["__id"], r.h["__tie"]) for r in heads.collect()), reverse=True)
    targets = [(b, i, t, firsts[k - 1][0]) for k, (b, i, t) in enumerate(firsts)]  # the first of all goes to the last bucket
    extra = spark.createDataFrame(targets, "__bucket int, __id long, __tie long, __target int")
    copies = dealt.join(F.broadcast(extra), ["__bucket", "__id", "__tie"]).withColumn("__bucket", F.col("__target")).drop("__target")
    return dealt.withColumn("__copy", F.lit(0)).unionByName(copies.withColumn("__copy", F.lit(1)))


def with_next(dealt: DataFrame, *carried: str) -> DataFrame:
    """Rows of ``dealt_in_order`` with ``next``: those columns of the next row in descending order, cyclically."""
    order = Window.partitionBy("__bucket").orderBy("__copy", F.desc("__id"), F.desc("__tie"))
    return dealt.withColumn("next", F.lead(F.struct(*carried)).over(order)).filter("__copy = 0").drop("__copy", "__bucket")


def imatch(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses."""
    words = lexicon(docs, text)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = base.withColumns({"__id": F.coalesce("doc_id", F.lit(LOWEST)), "__tie": F.xxhash64("text")})
    dealt = dealt_in_order(base).repartition("__bucket")  # before the fingerprints, which need not be shuffled
    rows = with_next(with_fingerprint(dealt, "text", words, "f"), "text", "f_few", "f_hashes")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("tail", F.floor(F.col("n_chars") / 3).cast("int"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - F.col("tail")), F.substring(F.col("next.text"), F.lit(1), F.col("tail"))))
    rows = with_fingerprint(rows, "edited", words, "e")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text("f").alias("fingerprint"),
        as_text("e").alias("edited_fingerprint"),
        likeness("f", "text", "e", "edited").alias("near_edited"),
        likeness("f", "text", "next.f", "next.text").alias("near_next"),
    )
