"""Scores of whole narratives: cohesion, factlets, alignment with evidence, banded quality, comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as X

# Words that tie a sentence to the one before.
BRIDGES = ["because", "so", "therefore", "as a result", "thus", "while", "although", "however", "meanwhile", "later", "earlier", "before", "after"]
# Words that announce a step back in time.
BACKWARD = ["earlier", "before", "previously", "flashback"]
# Metric -> (score 0 at, score 100 at).
NQI_BANDS = {"flesch": (30.0, 60.0), "entity_overlap": (0.05, 0.35), "content_overlap": (0.02, 0.15), "distinct_2": (0.20, 0.50), "trigram_repetition": (0.10, 0.02), "violations_per_1k": (2.0, 0.0)}


def local_band(sentences: DataFrame, doc: str, low: float = 0.15, high: float = 0.65) -> DataFrame:
    """Share of neighbouring sentences whose token Jaccard lies in a band; 1 for single sentences."""
    w = Window.partitionBy(doc).orderBy("pos")
    t = sentences.withColumn("t", F.array_distinct(X.tokens(F.col("text")))).withColumn("j", F.when(F.lag("t").over(w).isNotNull(), X.jaccard(F.col("t"), F.lag("t").over(w))))
    return t.groupBy(doc).agg(F.coalesce(F.avg(F.col("j").between(low, high).cast("double")), F.lit(1.0)).alias("local_band"))


def _padded(text: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(text), F.lit(" "))


def _bridged(padded: Column) -> Column:
    hit = F.lit(False)
    for word in BRIDGES:
        hit = hit | padded.contains(f" {word} ")
    return hit


def _clamped(share: Column) -> Column:
    return (F.least(F.lit(0.6), F.greatest(F.lit(0.2), share)) - 0.2) / 0.4


def bridge_rate(sentences: DataFrame, doc: str) -> DataFrame:
    """Share of sentences with a bridging word, clamped to 0.2..0.6 and scaled to 0..1."""
    return sentences.groupBy(doc).agg(_clamped(F.avg(_bridged(_padded(F.col("text"))).cast("double"))).alias("bridge_rate"))


def temporal_consistency(sentences: DataFrame, doc: str) -> DataFrame:
    """One minus the share of dated sentences that go back before the last dated one without saying so."""
    years = F.transform(X.years(F.col("text")), lambda y: y.cast("int"))
    before = Window.partitionBy(doc).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    s = sentences.withColumns({"first": F.array_min(years), "last": F.array_max(years)}).withColumn("known", F.last("first", ignorenulls=True).over(before))
    pair = F.col("known").isNotNull() & F.col("last").isNotNull()
    said = F.lower("text").rlike("|".join(BACKWARD))
    back = pair & (F.col("last") < F.col("known")) & ~said
    n = F.sum(pair.cast("int"))
    return s.groupBy(doc).agg(F.when(n == 0, 1.0).otherwise(1 - F.sum(back.cast("int")) / n).alias("temporal"))


def entity_flow(near: Column, pairs: Column) -> Column:
    """0.7 of the share of neighbours that name a common entity, 0.3 of how many they share (two at most).

    ``near`` holds how many entities each two neighbouring sentences share.
    """
    share = F.size(F.filter(near, lambda n: n > 0)) / pairs
    shared = F.aggregate(near, F.lit(0), lambda t, n: t + F.least(n, F.lit(2))) / pairs / 2
    return 0.7 * share + 0.3 * shared


def reference_stability(said: Column, names: Column) -> Column:
    """1 less 0.25 for every form beyond two that an entity has on average among the capitalised names of the text; 0 at least."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, "[^A-Za-z0-9 ]+", "")))
    forms = F.array_distinct(F.regexp_extract_all(F.array_join(said, " "), F.lit(r"(?U)\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})\b"), 1))
    known = F.array_distinct(F.filter(F.transform(names, norm), lambda e: e != ""))
    count = lambda plain: F.filter(F.transform(known, lambda e: F.size(F.filter(plain, lambda f: F.contains(f, e)))), lambda n: n > 0)
    extra = lambda found: F.aggregate(found, F.lit(0), lambda t, n: t + F.greatest(n - 2, F.lit(0)))
    score = lambda found: F.when(F.size(found) == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - 0.25 * extra(found) / F.size(found)))
    return _once(_once(F.transform(forms, norm), count), score)


def _once(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _temporal(said: Column) -> Column:
    """``temporal_consistency`` of the sentences of one document, in order."""
    years = lambda x: F.transform(X.years(x), lambda y: y.cast("int"))
    span = lambda x, y: F.struct(F.array_min(y).alias("first"), F.array_max(y).alias("last"), F.lower(x).rlike("|".join(BACKWARD)).alias("told"))
    # most sentences hold no digit, and no year without one
    dated = F.transform(F.filter(said, lambda x: x.rlike("(?:19|20)[0-9]{2}")), lambda x: _once(years(x), lambda y: F.when(F.size(y) > 0, span(x, y))))
    start = F.struct(F.lit(None).cast("int").alias("known"), F.lit(0).alias("n"), F.lit(0).alias("back"))

    def step(s: Column, x: Column) -> Column:
        pair = s["known"].isNotNull()
        back = pair & (x["last"] < s["known"]) & ~x["told"]
        return F.struct(x["first"].alias("known"), (s["n"] + pair.cast("int")).alias("n"), (s["back"] + back.cast("int")).alias("back"))

    return F.aggregate(F.filter(dated, lambda x: x.isNotNull()), start, step, lambda s: F.when(s["n"] == 0, 1.0).otherwise(1 - s["back"] / s["n"]))


def cohesion(sentences: DataFrame, entities: DataFrame, doc: str) -> DataFrame:
    """The parts and their weighted sum. Sentences and entities of a document are brought into one row."""
    said = sentences.filter(F.col(doc).isNotNull()).groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("said"))
    names = entities.groupBy(doc).agg(F.collect_set("entity").alias("names"))
    return cohesion_of(said.join(names, doc, "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>"))), doc)


def cohesion_of(rows: DataFrame, doc: str) -> DataFrame:
    """``cohesion`` of rows ``(doc, said, names)``: sentences in order, one at least, and entities of one document. Nothing is shuffled.

    Entities are matched as substrings, case ignored, inside their document. Rows of one id are judged apart.
    """
    n = F.size("said")
    kinds = F.transform("said", lambda x: F.array_distinct(F.transform(X.tokens(x), lambda t: F.xxhash64(t))))
    lowered = F.array_distinct(F.transform(F.filter("names", lambda e: e != ""), lambda e: F.lower(e)))
    rows = rows.withColumns({"__t": kinds, "__e": lowered})
    # places of the entities, which are cheaper to compare than their names
    named = F.transform("said", lambda x: _once(F.lower(x), lambda low: F.filter(F.transform("__e", lambda e, i: F.when(F.contains(low, e), i)), lambda i: i.isNotNull())))
    rows = rows.withColumn("__n", F.when(F.size("__e") > 0, named).otherwise(F.array().cast("array<array<int>>")))
    after = lambda c, f: F.transform(F.slice(c, F.lit(2), F.greatest(F.size(c), F.lit(1))), lambda x, i: f(F.get(c, i), x))
    pairs = F.greatest(n - 1, F.lit(1))
    inside = F.size(F.filter(after("__t", lambda a, b: X.jaccard(a, b)), lambda j: j.between(0.15, 0.65)))
    rows = rows.withColumn("__near", after("__n", lambda a, b: F.size(F.array_intersect(a, b))))
    out = rows.select(
        doc,
        F.when(n < 2, F.lit(1.0)).otherwise(inside / pairs).alias("local_band"),
        entity_flow(F.col("__near"), pairs).alias("entity_flow"),
        _clamped(F.size(F.filter("said", lambda x: _once(_padded(x), _bridged))) / n).alias("bridge_rate"),
        _temporal(F.col("said")).alias("temporal"),
        reference_stability(F.col("said"), F.col("names")).alias("ref_stability"),
    )
    score = 0.35 * F.col("local_band") + 0.25 * F.col("entity_flow") + 0.15 * F.col("bridge_rate") + 0.15 * F.col("temporal") + 0.10 * F.col("ref_stability")
    return out.withColumn("cohesiveness", F.round(score, 3))


def factlet_support(sentences: DataFrame, factlets: DataFrame, group: str, least: int = 2, threshold: float = 0.22) -> DataFrame:
    """Sentences with ``supported``: some factlet of the group shares two content tokens and is like enough."""
    kinds = lambda df, n: df.withColumn(n, F.array_distinct(F.transform(X.content_tokens(F.col("text")), lambda t: F.xxhash64(t))))
    s, f = kinds(sentences, "st"), kinds(factlets, "ft").select(group, "ft")
    shared = F.size(F.array_intersect("st", "ft"))
    ok = (shared >= least) & (shared / (F.size("st") + F.size("ft") - shared) >= threshold)
    hits = s.join(f, group).groupBy(group, "pos").agg(F.max(ok.cast("int")).alias("m"))
    return sentences.join(hits, [group, "pos"], "left").withColumn("supported", F.coalesce(F.col("m") == 1, F.lit(False))).drop("m")


def factlet_coverage(texts: DataFrame, factlets: DataFrame, group: str, least: int = 2) -> DataFrame:
    """Share of a group's factlets that its text touches."""
    t = texts.select(group, F.array_distinct(X.content_tokens(F.col("text"))).alias("tt"))
    f = factlets.select(group, F.array_distinct(X.content_tokens(F.col("text"))).alias("ft"))
    return t.join(f, group).groupBy(group).agg(F.avg((F.size(F.array_intersect("tt", "ft")) >= least).cast("double")).alias("coverage"))


def aligned(sentences: DataFrame, evidence: DataFrame, group: str, n: int = 3, threshold: float = 0.38) -> DataFrame:
    """Per group: share of evidence lines that some sentence holds whole, shares an n-gram with, or is like; and of such sentences."""
    norm = lambda c: X.squeeze(F.lower(c))
    s = sentences.select(group, F.col("pos").alias("sp"), norm(F.col("text")).alias("sx")).withColumn("st", X.tokens(F.col("sx")))
    e = evidence.select(group, F.col("pos").alias("ep"), norm(F.col("text")).alias("ex")).withColumn("et", X.tokens(F.col("ex"))).filter(F.size("et") > 0)
    like = X.jaccard(F.array_distinct("st"), F.array_distinct("et")) >= threshold
    hit = F.contains("sx", "ex") | like | X.contains_ngram(F.col("et"), F.col("st"), n)
    pairs = s.join(e, group).withColumn("hit", hit.cast("int"))
    covered = pairs.groupBy(group, "ep").agg(F.max("hit").alias("h")).groupBy(group).agg(F.avg("h").alias("coverage"))
    support = pairs.groupBy(group, "sp").agg(F.max("hit").alias("h")).groupBy(group).agg(F.avg("h").alias("support"))
    return covered.join(support, group)


def nqi_lite(rows: DataFrame) -> DataFrame:
    """Six banded scores of 0..100 to one decimal and their mean."""
    scores = {f"{m}_score": F.round(X.linear_map(F.col(m), *band), 1) for m, band in NQI_BANDS.items()}
    out = rows.withColumns(scores)
    return out.withColumn("nqi_lite", F.round(sum((F.col(c) for c in list(scores)[1:]), F.col(next(iter(scores)))) / len(scores), 1))


def best_setting(rows: DataFrame, group: str, metric: str, tie: list[str]) -> DataFrame:
    """Each group's row with the highest metric, the first by ``tie`` of equals."""
    columns = rows.columns
    best = rows.groupBy(group).agg(F.max_by(F.struct(*columns), F.struct(F.col(metric), *(-F.col(t) for t in tie))).alias("r"))
    return best.select(*(F.col(f"r.{c}").alias(c) for c in columns))


def diversity(refs: DataFrame, run: str, key: str, kind: str) -> DataFrame:
    """Per run: references, distinct ones, the share of the three commonest, and of each kind."""
    n = refs.groupBy(run, key).agg(F.count("*").alias("n"))
    top = n.withColumn("r", F.row_number().over(Window.partitionBy(run).orderBy(F.desc("n"), key))).groupBy(run).agg(
        F.sum("n").alias("refs"), F.count("*").alias("distinct_refs"), F.sum(F.when(F.col("r") <= 3, F.col("n")).otherwise(0)).alias("top3")
    )
    web = refs.groupBy(run).agg(F.avg((F.col(kind) == "web").cast("double")).alias("web_share"))
    return top.join(web, run).select(run, "refs", "distinct_refs", (F.col("distinct_refs") / F.col("refs")).alias("unique_share"), (F.col("top3") / F.col("refs")).alias("top3_share"), "web_share")


def alias_pairs(pairs: DataFrame, a: str, b: str, k: int = 80) -> DataFrame:
    """Names that only one side of matched lines has, paired across the sides and counted; the commonest ``k``."""
    x = pairs.select(F.array_distinct(X.proper_nouns(F.col(a))).alias("x"), F.array_distinct(X.proper_nouns(F.col(b))).alias("y"))
    only = x.select(F.array_except("x", "y").alias("x"), F.array_except("y", "x").alias("y"))
    crossed = only.select(F.explode("x").alias("left"), "y").select("left", F.explode("y").alias("right"))
    return crossed.groupBy("left", "right").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "left", "right").limit(k)


def mean_skipping(x: Column) -> Column:
    """Average without missing values and NaN."""
    return F.avg(F.when(~F.isnan(x), x))
