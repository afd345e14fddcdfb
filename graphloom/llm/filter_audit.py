"""Filter interaction audit: what each filter removes alone, after others and in every order.

Whole texts are tested once by five filters. The counts of each combination of
failures in a part are cubed: a grouping-set row whose chosen flags are all false
counts the documents that survive just those filters. A step of an order is a
pair of such subsets, the filters applied before it and those and its own, so all
120 orders come from 80 pairs a part and no document is read twice.

``failures`` and ``survivors`` serve any five filters: give other conditions for
``FILTERS``. Each part of the data is a value of one column.

* Null texts are empty: they fail A (too short) and nothing else, but for E where
  a smaller id's text is empty too.
* E looks at the smallest id of equal texts table-wide: rows that repeat that id
  are kept, all rows of larger ids fail. A row without an id has no place in that
  order: it never fails E and makes no other row fail.
* Parts are told apart by value; null and the empty string are one part.
* Labels: a document counts as good (toxic) where any label row of its id says 1.
  Rows without an id, null marks and ids without a label count as neither.
* Empty documents give no rows; an empty label table gives zeros. Only doc_id,
  text and the part's column are read, so other columns cannot clash.
"""

from __future__ import annotations

from itertools import combinations, permutations
from math import factorial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import cut

LETTERS = "ABCDE"
ALL = (1 << len(LETTERS)) - 1
WORD = r"[^\x20\x09-\x0D]+"
MARKS = ["docs", "good", "toxic"]


def bit(letter: str) -> int:
    return 1 << (len(LETTERS) - 1 - LETTERS.index(letter))


def failures(docs: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part, digest of the text and the conditions A to D of every row."""
    text = F.coalesce("text", F.lit(""))
    told = docs.select(
        F.col("doc_id").alias("doc_id"),
        F.coalesce(F.col(part), F.lit("")).alias("part"),
        text.alias("text"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
    )
    n, chars = F.size("words"), F.length("text")
    capitals = chars - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return told.select(
        "doc_id",
        "part",
        F.sha2(F.encode("text", "UTF-8"), 256).alias("digest"),
        (n < 200).alias("A"),
        (100 * F.size(F.array_distinct("words")) < 50 * n).alias("B"),
        (100 * capitals.cast("long") > 3 * chars.cast("long")).alias("C"),
        F.col("text").rlike(r"[#$%&*|]").alias("D"),
    )


def marks(labels: DataFrame) -> DataFrame:
    """Every labelled id once: good, toxic."""
    said = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    return labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(said("quality").alias("good"), said("toxic").alias("toxic"))


def profile(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, good and toxic ones of each part and combination of the five failures.

    Equal texts share A to D, so the first id of a text is found on counts of
    its copies, never on the copies: a text that a third of all rows hold is a
    row a task before the shuffle. Rows without an id are dealt by their text.
    """
    flags = list("ABCD")
    once = rows.groupBy("doc_id", "digest", "part", *flags).agg(F.count(F.lit(1)).alias("n"))
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(0)
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    told = once.withColumn("spread", spread).join(marks(labels).withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left")
    told = told.select("doc_id", "digest", "part", *flags, "n", no("good"), no("toxic"), F.col("doc_id").isNull().alias("unnamed"))
    copies = told.groupBy("digest", "part", *flags, "good", "toxic", "unnamed").agg(F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("at_first"))
    first = F.min("first").over(Window.partitionBy("digest"))
    fresh = F.when(F.col("unnamed"), F.col("n")).when(F.col("first") == F.col("of_text"), F.col("at_first")).otherwise(0)
    both = F.array(F.struct(F.lit(False).alias("E"), F.col("fresh").alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("fresh")).alias("n")))
    split = copies.withColumn("of_text", first).withColumn("fresh", fresh).select("part", *flags, "good", "toxic", F.inline(both)).where("n > 0")
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return split.groupBy("part", *LETTERS).agg(F.sum("n").alias("docs"), total(F.col("good")).alias("good"), total(F.col("toxic")).alias("toxic"))


def survivors(counts: DataFrame) -> DataFrame:
    """part, mask, docs, good, toxic: what survives the filters of ``mask`` (bit 16 is A, bit 1 is E), and only those.

    From a cube over part and flags. Rows over all parts have ``part`` null and
    ``every`` true. Subsets that nothing survives have no row.
    """
    sums = [F.sum(c).alias(c) for c in MARKS]
    cubed = counts.cube("part", *LETTERS).agg(*sums, F.grouping_id().alias("gid"))
    unfailed = F.lit(True)
    for x in LETTERS:
        unfailed = unfailed & ~F.coalesce(F.col(x), F.lit(False))
    mask = F.lit(ALL) - F.col("gid").bitwiseAND(F.lit(ALL))
    return cubed.where(unfailed).select("part", (F.col("gid") > ALL).alias("every"), mask.cast("int").alias("mask"), *MARKS)


def pairs(alive: DataFrame) -> DataFrame:
    """Each filter after each subset of the others, by part: kept, removed, good_lost, toxic_lost, and in how many orders that happens."""
    spark = alive.sparkSession
    masks = alive.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(ALL))).alias("mask"))
    full = masks.join(alive, ["part", "mask"], "left").fillna(0, MARKS)
    others = [(x, c) for x in LETTERS for k in range(len(LETTERS)) for c in combinations(LETTERS.replace(x, ""), k)]
    rows = [(x, sum(map(bit, c)), sum(map(bit, c)) + bit(x), factorial(len(c)) * factorial(len(LETTERS) - 1 - len(c))) for x, c in others]
    steps = spark.createDataFrame(rows, "letter string, before int, after int, orders long")  # 80 rows, always
    was, now = (full.select("part", F.col("mask").alias(m), *(F.col(c).alias(f"{c}_{m}") for c in MARKS)) for m in ("before", "after"))
    lost = lambda c: F.col(f"{c}_before") - F.col(f"{c}_after")
    joined = was.join(F.broadcast(steps), "before").join(now, ["part", "after"])
    return joined.select("part", "letter", "before", "orders", F.col("docs_after").alias("kept"), lost("docs").alias("removed"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row a part, order of the five filters and step; zeros included."""
    spark = docs.sparkSession
    counts = cut(profile(failures(docs, part), labels), "audit", 1)  # at most 32 rows a part
    pair = pairs(survivors(counts).where(~F.col("every")).drop("every"))
    only = lambda c: F.sum(F.when(c, F.col("removed")).otherwise(0))
    last = F.lit(ALL) - F.col("bit")
    letters = spark.createDataFrame([(x, bit(x)) for x in LETTERS], "letter string, bit int")
    alone = pair.join(F.broadcast(letters), "letter").groupBy("part", "letter").agg(
        only(F.col("before") == 0).alias("failing"),
        only(F.col("before") == last).alias("unique_fails"),
        F.sum(F.col("removed") * F.col("orders")).alias("shapley"),
    )
    rows = [("".join(p), k + 1, p[k], sum(map(bit, p[:k]))) for p in permutations(LETTERS) for k in range(len(LETTERS))]
    steps = spark.createDataFrame(rows, "filter_order string, step int, letter string, before int")  # 600 rows, always
    out = pair.join(alone, ["part", "letter"]).join(F.broadcast(steps), ["letter", "before"])
    long = lambda c, name: c.cast("long").alias(name)
    return out.select(
        "part",
        "filter_order",
        "step",
        long(F.col("kept"), "kept"),
        long(F.col("removed"), "removed"),
        long(F.col("failing") - F.col("removed"), "redundant"),
        long(F.col("unique_fails"), "unique_fails"),
        long(F.col("good_lost"), "good_lost"),
        long(F.col("toxic_lost"), "toxic_lost"),
        long(F.col("shapley"), "shapley"),
    )
