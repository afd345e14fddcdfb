"""Support and coverage of text by evidence, fusion, decisions, and narrative statistics.

Sentences and evidence lines meet only inside their group (a beat or a run), on
token arrays computed once per line. Every pair is scored and the best one kept
by an aggregate, so no pair table is materialised.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import distinct_order
from graphloom.functions import text as X

#: More than a TF-IDF cosine can change by the order of its sums (8.9e-16 measured).
SLACK = 1e-9


@dataclass(frozen=True)
class Settings:
    tf_threshold: float = 0.35
    cj_threshold: float = 0.28
    use_tfidf: bool = True
    use_char3: bool = True
    fusion: str = "max"
    rrf_k: int = 60
    decision: str = "any"
    vote_k: int = 2
    compat_years: bool = False


def featured(lines: DataFrame, text: str, settings: Settings) -> DataFrame:
    """What comparing needs of each line: hashed tokens and 3-grams, names, numbers, years.

    Hashes of 64 bits stand for the strings: arrays of longs intersect without
    boxing. ``reps`` holds the tokens that repeat with their counts,
    ``squares`` the sum of all counts squared.
    """
    hashed = lambda c: F.transform(c, lambda x: F.xxhash64(x))
    lines = lines.withColumn("tok", hashed(X.tokens(X.strip_noise(F.col(text))))).withColumn("kinds", F.array_distinct("tok"))
    counted = F.when(F.size("tok") > F.size("kinds"), F.filter(X.count_map(F.col("tok")), lambda r: r["n"] > 1)).otherwise(F.array().cast("array<struct<t:bigint,n:int>>"))
    lines = lines.withColumn("reps", counted)
    return lines.withColumns({
        "squares": F.size("kinds") + F.aggregate("reps", F.lit(0), lambda a, r: a + r["n"] * r["n"] - 1),
        "gram": X.gram_hashes(F.col(text)), "names": X.proper_nouns(F.col(text)), "nums": X.numbers(F.col(text)), "years": X.years(F.col(text), settings.compat_years),
    })


FEATURES = ["kinds", "reps", "squares", "gram", "names", "nums", "years"]


def dealt(lines: DataFrame, group: str, side: str, settings: Settings) -> DataFrame:
    """Featured lines as one side of pairs, dealt over all shuffle partitions by group.

    Pairs cost far more than lines; a join on the group needs no shuffle after this.
    """
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = featured(lines.select(group, "pos", "text").repartition(n, group), "text", settings)
    return out.select(group, *(F.col(c).alias(f"{side}_{c}") for c in ("pos", "text", *FEATURES)))


def scored(both: DataFrame) -> DataFrame:
    """Adds tfidf, char3, names, nums, years to rows with both sides' features.

    The TF-IDF cosine (``pair_tfidf_cosine``) is counted from the kinds of tokens both lines share:
    each adds one to the product and to both squares, and only the few that repeat add more.
    """
    both = both.withColumns({"__s": F.array_intersect("q_kinds", "c_kinds"), "__g": F.size(F.array_intersect("q_gram", "c_gram"))})
    hit = lambda f: F.when((F.size(f"q_{f}") > 0) & (F.size(f"c_{f}") > 0) & F.arrays_overlap(f"q_{f}", f"c_{f}"), 1.0).otherwise(0.0)
    grams = F.size("q_gram") + F.size("c_gram") - F.col("__g")
    char3 = F.when((F.size("q_gram") == 0) | (F.size("c_gram") == 0), F.lit(0.0)).otherwise(F.col("__g") / grams)
    repeated = lambda side: F.filter(f"{side}_reps", lambda r: F.array_contains("__s", r["t"]))
    none = F.array().cast("array<struct<t:bigint,n:int>>")
    both = both.withColumns({"__t": F.size("__s"), **{f"__{x}": F.when((F.size("__s") > 0) & (F.size(f"{x}_reps") > 0), repeated(x)).otherwise(none) for x in "qc"}})
    add = lambda reps, f: F.aggregate(reps, F.lit(0), lambda a, r: a + f(r))
    # a token that repeats in both adds n * m - 1; of those sums n - 1 and m - 1 are in what it adds as repeating in either
    twice = add("__q", lambda r: F.aggregate("__c", F.lit(0), lambda a, x: a + F.when(x["t"] == r["t"], (r["n"] - 1) * (x["n"] - 1)).otherwise(0)))
    dot = F.col("__t") + add("__q", lambda r: r["n"] - 1) + add("__c", lambda r: r["n"] - 1) + twice
    alone = (math.log(1.5) + 1) * (math.log(1.5) + 1)

    def norm(side: str) -> Column:
        shared = F.col("__t") + add(f"__{side}", lambda r: r["n"] * r["n"] - 1)
        return F.sqrt(shared + (F.col(f"{side}_squares") - shared) * F.lit(alone)) + 1e-9

    tfidf = F.when(F.col("__t") == 0, F.lit(0.0)).otherwise(dot / (norm("q") * norm("c")))
    return both.withColumns({"tfidf": tfidf, "char3": char3, "names": hit("names"), "nums": hit("nums"), "years": hit("years")}).drop("__s", "__t", "__g", "__q", "__c")


def pairs(queries: DataFrame, candidates: DataFrame, group: str, settings: Settings) -> DataFrame:
    """All (query, candidate) pairs of each group with their features; both sides have ``group``, pos, text."""
    both = dealt(queries, group, "q", settings).join(dealt(candidates, group, "c", settings).hint("shuffle_hash"), group)
    return scored(both).select(group, "q_pos", "q_text", "c_pos", "c_text", "tfidf", "char3", "names", "nums", "years")


def fused(rows: DataFrame, group: str, settings: Settings) -> Column:
    parts = [F.col(n) for n, use in (("tfidf", settings.use_tfidf), ("char3", settings.use_char3)) if use]
    if not parts:
        return F.lit(0.0)
    total = sum(parts[1:], parts[0])
    if settings.fusion == "mean":
        return total / len(parts)
    if settings.fusion == "sum":
        return total
    if settings.fusion == "mnz":
        return total * sum(((p > 0).cast("int") for p in parts[1:]), (parts[0] > 0).cast("int"))
    if settings.fusion == "rrf":
        w = Window.partitionBy(group, "q_pos")
        ranks = [1.0 / (settings.rrf_k + F.row_number().over(w.orderBy(p.desc(), "c_pos"))) for p in parts]
        return sum(ranks[1:], ranks[0])
    return F.greatest(*parts) if len(parts) > 1 else parts[0]


def best_match(queries: DataFrame, candidates: DataFrame, group: str, settings: Settings = Settings()) -> DataFrame:
    """Each query with its best candidate, the earliest of equals; queries of groups without candidates have none.

    The best pair is found with one decimal per pair (signal to nine decimals, then
    place, up to 2**48), which aggregates by hash without a sort; only the chosen pairs get
    their texts and features again.
    """
    q, c = dealt(queries, group, "q", settings), dealt(candidates, group, "c", settings)
    every = scored(q.drop("q_text").join(c.drop("c_text").hint("shuffle_hash"), group))
    signal = F.round(fused(every, group, settings) + 0.06 * F.col("names") + 0.04 * F.greatest("nums", "years"), 9)
    span = 1 << 48
    packed = F.round(signal * 1e9).cast("decimal(18,0)") * F.lit(span).cast("decimal(16,0)") + (F.lit(span - 1) - F.col("c_pos"))
    best = every.select(group, "q_pos", packed.cast("decimal(36,0)").alias("m")).groupBy(group, "q_pos").agg(F.max("m").alias("m"))
    rest = F.pmod("m", F.lit(span).cast("decimal(16,0)"))
    best = best.select(group, "q_pos", (F.lit(span - 1) - rest).cast("long").alias("c_pos"), (((F.col("m") - rest) / F.lit(span).cast("decimal(16,0)")).cast("double") / 1e9).alias("signal"))
    chosen = scored(q.join(best, [group, "q_pos"]).join(c, [group, "c_pos"]))
    feats = ["tfidf", "char3", "names", "nums", "years"]
    out = chosen.select(group, F.col("q_pos").alias("pos"), F.col("q_text").alias("text"), "signal", F.col("c_pos").alias("best_pos"), "c_text", *feats)
    lonely = queries.select(group, "pos", "text").join(candidates.select(group).distinct(), group, "left_anti")
    zeros = {f: F.lit(0.0) for f in feats}
    return out.unionByName(lonely.withColumns({"signal": F.lit(-1.0), "best_pos": F.lit(-1).cast("long"), "c_text": F.lit(""), **zeros}))


def decide(matched: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``supported``, the lexical score L and the rule that decided."""
    anchor = (F.col("names") >= 1) & ((F.col("nums") >= 1) | (F.col("years") >= 1))
    tests = []
    if settings.use_tfidf:
        tests.append(F.col("tfidf") >= settings.tf_threshold)
    if settings.use_char3:
        tests.append(F.col("char3") >= settings.cj_threshold)
    votes = sum((t.cast("int") for t in tests), F.lit(0))
    if settings.decision == "all":
        lexical, rule = (votes == len(tests)) & F.lit(bool(tests)), F.lit("all")
    elif settings.decision == "vote":
        k = max(1, min(settings.vote_k, len(tests) or 1))
        lexical, rule = votes >= k, F.concat(F.lit("vote("), votes.cast("string"), F.lit(f"/{k})"))
    else:
        lexical, rule = votes > 0, F.lit("any")
    said = rule if settings.decision == "vote" else F.when(lexical, rule).otherwise("none")
    scores = [F.col(n) for n, use in (("tfidf", settings.use_tfidf), ("char3", settings.use_char3)) if use]
    top = F.greatest(*scores) if len(scores) > 1 else scores[0] if scores else F.lit(0.0)
    return matched.withColumns({
        "supported": anchor | lexical, "L": top,
        "rule": F.when(anchor & ~lexical, "anchor").when(anchor & lexical, F.concat(F.lit("anchor+"), said)).otherwise(said),
    })


def summary(decided: DataFrame, group: str) -> DataFrame:
    """Per group: distinct texts, supported ones, percentage."""
    return decided.groupBy(group).agg(
        F.count_distinct("text").alias("n"), F.sum(F.col("supported").cast("int")).alias("supported"), F.round(100 * F.avg(F.col("supported").cast("double")), 6).alias("pct")
    )


def near_misses(decided: DataFrame, low: float = 0.28, high: float = 0.35, k: int = 200) -> DataFrame:
    """The ``k`` unsupported lines whose score falls just short."""
    return decided.filter(~F.col("supported") & (F.col("L") >= low) & (F.col("L") < high)).orderBy(F.desc("L"), *[c for c in decided.columns if c in ("conv_id", "pos")]).limit(k)


def to_the_last_digit(matched: DataFrame, low: float, high: float, k: int) -> DataFrame:
    """The matched lines that can be among the ``k`` near misses, with ``tfidf`` summed in the SQL's order.

    Lines whose scores are one number on paper are ranked by the last digits of their sums there.
    A task sums again only what reaches the ``k``-th best near miss it has seen, so it holds
    one batch and ``k`` scores; every tie at the end is kept.
    """
    moved = lambda rows, by: decide(rows.drop("supported", "L", "rule").withColumn("tfidf", F.col("tfidf") + by))
    rows = moved(matched, -SLACK).filter(~F.col("supported") & (F.col("L") >= low - 2 * SLACK) & (F.col("L") < high))
    rows = moved(rows, 2 * SLACK).withColumn("__sure", ~F.col("supported"))
    joined = lambda c: F.array_join(X.tokens(X.strip_noise(F.col(c))), " ")
    rows = rows.select(*matched.columns, "__sure", joined("text").alias("__a"), joined("c_text").alias("__b"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        best: list[float] = []
        for batch in batches:
            tfidf, char3 = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("tfidf", "char3"))
            sure, a, b = (batch.column(c) for c in ("__sure", "__a", "__b"))
            top, kept = np.maximum(tfidf, char3), []
            for i in np.argsort(-top).tolist():
                if len(best) == k and top[i] < best[0] - 3 * SLACK:
                    break
                tfidf[i] = distinct_order.tfidf_cosine(a[i].as_py().split(), b[i].as_py().split())
                kept.append(i)
                score = float(max(tfidf[i], char3[i]))
                if sure[i].as_py() and low <= score < high:
                    (heapq.heappush if len(best) < k else heapq.heappushpop)(best, score)
            whole = batch.set_column(batch.schema.get_field_index("tfidf"), "tfidf", pa.array(tfidf))
            yield whole.select(matched_columns).take(pa.array(kept, pa.int64()))

    matched_columns = matched.columns
    return rows.mapInArrow(run, matched.schema)


# --- narrative statistics: one row per text in, one row per text out ---


def narrative(df: DataFrame, text: str) -> DataFrame:
    """Repetition, variety, flow and readability of each text, from arrays only: no shuffle."""
    s, w = F.col("__s"), F.col("__w")
    rows = df.withColumns({"__s": X.sentences(F.col(text), "C"), "__w": X.tokens(F.col(text))})
    kinds = lambda n: F.when(F.size(w) < n, F.lit(0)).otherwise(F.size(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, n))))))
    rows = rows.withColumns({
        "__k1": F.size(F.array_distinct(F.transform(w, lambda x: F.xxhash64(x)))), "__k2": kinds(2), "__k3": kinds(3),
        "__c": F.transform(s, lambda x: F.array_distinct(F.transform(X.content_tokens(x), lambda t: F.xxhash64(t)))),
        "__y": F.aggregate(w, F.lit(0), lambda a, x: a + X.syllables(x)),
    })
    near = F.when(F.size(s) < 2, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))), lambda i: X.jaccard(F.get("__c", i - 1), F.get("__c", i), 1.0)))
    rows = rows.withColumn("__j", near)
    mean = lambda a: F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a))
    share = lambda test: F.when(F.size(s) == 0, F.lit(0.0)).otherwise(F.size(F.filter(s, test)) / F.size(s))
    ratio = lambda k, n: F.when(F.size(w) < n, F.lit(0.0)).otherwise(F.col(k) / (F.size(w) - (n - 1)))
    cues = "^(" + "|".join(X.TRANSITIONS) + ")"
    return rows.withColumns({
        "n_sentences": F.size(s).cast("long"), "n_tokens": F.size(w).cast("long"), "ttr": ratio("__k1", 1), "distinct_2": ratio("__k2", 2), "distinct_3": ratio("__k3", 3),
        "trigram_repetition": F.when(F.size(w) < 3, F.lit(0.0)).otherwise(1 - ratio("__k3", 3)),
        "adjacent_overlap": mean(F.col("__j")), "transition_rate": share(lambda x: F.lower(x).rlike(cues)),
        "passive_rate": share(lambda x: x.rlike(r"(?i)\b(?:am|is|are|was|were|be|been|being)\b\s+\w+(?:ed|en)\b")),
        "flesch": X.flesch(F.size(s), F.size(w), F.col("__y")), "grade": X.grade(F.size(s), F.size(w), F.col("__y")),
    }).drop("__s", "__w", "__k1", "__k2", "__k3", "__c", "__j", "__y")


def repeat_streak(docs: DataFrame, doc: str, text: str, threshold: float) -> DataFrame:
    """Per document with sentences the longest run of adjacent near-equal ones, found inside its row; repeated ids give their longest."""
    rows = docs.select(doc, F.transform(X.sentences(F.col(text)), lambda x: X.gram_hashes(x, pad=False)).alias("g")).filter(F.size("g") > 0)

    def near(i: Column) -> Column:
        a, b = F.get("g", i), F.get("g", i + 1)
        least, most = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
        # shared over all is at most the smaller over the larger
        return F.when(most == 0, F.lit(1.0 >= threshold)).when(least / most < threshold, F.lit(False)).otherwise(X.jaccard(a, b, 1.0) >= threshold)

    rows = rows.select(doc, F.transform(F.slice("g", F.lit(2), F.size("g")), lambda _, i: near(i)).alias("near"))
    start = F.struct(F.lit(1).cast("long").alias("run"), F.lit(1).cast("long").alias("most"))

    def longer(s: Column, near: Column) -> Column:
        run = F.when(near, s["run"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(run.alias("run"), F.greatest(s["most"], run).alias("most"))

    return rows.groupBy(doc).agg(F.max(F.aggregate("near", start, longer)["most"]).alias("streak"))


def carry_years(sentences: DataFrame, doc: str) -> DataFrame:
    """Each sentence with the last year known before it, and whether it goes back in time."""
    w = Window.partitionBy(doc).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    year = F.array_max(F.transform(X.years(F.col("text")), lambda y: y.cast("int")))
    rows = sentences.withColumn("year", year).withColumn("before", F.last("year", ignorenulls=True).over(w))
    return rows.withColumn("backward", F.coalesce(F.col("year") < F.col("before"), F.lit(False)))


def min_max(df: DataFrame, metrics: dict[str, bool], within: list[str]) -> DataFrame:
    """Each metric scaled to 0..1 inside its run, flipped where lower is better; 0.5 where constant or missing; ``nqi`` is 100 times their mean.

    The bounds of a run are one row, joined back: a run is never brought to one task.
    """
    bounds = df.groupBy(*(F.col(c).alias(f"__by_{i}") for i, c in enumerate(within))).agg(*(f(m).alias(f"__{n}_{m}") for m in metrics for n, f in (("low", F.min), ("high", F.max))))
    same = [F.col(c).eqNullSafe(F.col(f"__by_{i}")) for i, c in enumerate(within)]
    joined = df.join(bounds, same, "left").drop(*(f"__by_{i}" for i in range(len(within))))
    cols = {}
    for m, higher in metrics.items():
        low, high = F.col(f"__low_{m}"), F.col(f"__high_{m}")
        scaled = F.when(high > low, (F.col(m) - low) / (high - low))
        cols[f"{m}_norm"] = F.coalesce(scaled if higher else 1 - scaled, F.lit(0.5))
    out = joined.withColumns(cols).drop(*(f"__{n}_{m}" for m in metrics for n in ("low", "high")))
    names = list(cols)
    return out.withColumn("nqi", 100 * sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names))


def metric_stats(long: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, population deviation, minimum, linear quartiles and maximum per group."""
    return long.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"),
        *(F.percentile(value, q).alias(n) for q, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))), F.max(value).alias("max"),
    )
