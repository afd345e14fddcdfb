"""Metrics of single texts and of texts made of beats: redundancy, overlap, consistency, structure, quality checks, gate.

Metrics of one text are array expressions over its sentences and words, so they
need no shuffle. Metrics over the beats of a run are grouped sums: the mean
pairwise similarity of a run's beats follows from the length of the sum of their
vectors, so no pairs are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators.narrative import BACKWARD, BRIDGES

# Function words that say nothing of a text's content.
FUNCTION_WORDS = """
a an the and or but if while of for to in on at from by with without over under
this that these those is are was were be been being am do does did doing have has had
i you he she it we they them him her us our your their my mine yours his hers ours theirs
as into about above below up down out off again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than
too very s t can will just don don’t should now
""".split()
# Words that add nothing.
FILLERS = ["very", "really", "just", "quite", "kind", "sort", "basically", "actually", "literally", "simply", "somewhat", "rather"]
# How a beat concludes.
CONCLUSIONS = ["overall", "in the end", "ultimately", "in summary", "to sum up", "in conclusion"]
# Words of a sentence that goes on, and of one that goes back.
ONWARD, BACK = ["later", "afterwards", "after", "subsequently"], ["earlier", "before", "previously", "prior"]
YEAR = r"(?U)\b(1[89][0-9]{2}|20[0-9]{2})\b"
NAME = r"(?U)\b(?:[A-Z][a-z]+(?:\s+(?:of|the|and)\s+)?)+(?:[A-Z][a-z]+)\b"
COUNTED = r"(?U)\b(?:[0-9]{1,3}(?:,[0-9]{3})*|[0-9]+(?:\.[0-9]+)?)\s+[A-Za-z][a-z\-]+\b"
# Name -> bound of the quality checks.
QUALITY = {
    "fre_min": 40.0, "fkgl_max": 16.0, "avg_sent_len_min": 18, "avg_sent_len_max": 35, "single_sent_para_ratio_max": 0.60, "bigram_rep_max": 0.25, "trigram_rep_max": 0.15, "passive_rate_max": 0.35,
    "bridge_rate_min": 0.15, "bridge_rate_max": 0.60, "redundancy_rate_max": 0.20, "temporal_consistency_min": 0.70, "content_ttr_min": 0.35,
}


def over(n: Column, d: Column) -> Column:
    """A share, 0 where there is nothing to share."""
    return F.when(d == 0, F.lit(0.0)).otherwise(n / d)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def mean(a: Column) -> Column:
    return over(total(a), F.size(a))


def nearest_rank(a: Column, q: float) -> Column:
    """The smallest value that at least the share ``q`` of all reach; 0 of none."""
    at = F.greatest(F.ceil(F.lit(q) * F.size(a)).cast("int") - 1, F.lit(0))
    return F.coalesce(F.get(F.sort_array(a), at).cast("double"), F.lit(0.0))


def lower_quarter(a: Column) -> Column:
    """The value a quarter up the sorted array, counted down; 0 of none."""
    at = F.greatest(F.floor(F.size(a) * F.lit(0.25)).cast("int") - 1, F.lit(0))
    return F.coalesce(F.get(F.sort_array(a), at).cast("double"), F.lit(0.0))


def inclusive_quantile(a: Column, q: float) -> Column:
    """Linear between the ranks of the sorted array."""
    at = (F.size(a) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    x, y = F.get(F.sort_array(a), low), F.get(F.sort_array(a), F.least(low + 1, F.size(a) - 1))
    return x + (y - x) * (at - low)


def iqr_over_median(a: Column) -> Column:
    """Spread of the middle half over the median (over 1 where that is 0); 0 of fewer than two values."""
    median = inclusive_quantile(a, 0.5)
    return F.when(F.size(a) < 2, F.lit(0.0)).otherwise((inclusive_quantile(a, 0.75) - inclusive_quantile(a, 0.25)) / F.when(median == 0, F.lit(1.0)).otherwise(median))


def adjacent(a: Column, f) -> Column:
    """``f`` of each element and the next."""
    return F.when(F.size(a) < 2, F.array()).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(a) - 1, F.lit(1))), lambda i: f(F.get(a, i - 1), F.get(a, i))))


def is_content(w: Column) -> Column:
    return w.rlike("^[a-z]+$") & ~w.isin(FUNCTION_WORDS)


def entities(c: Column) -> Column:
    """Names of two words or more and acronyms."""
    return F.concat(F.regexp_extract_all(c, F.lit(NAME), 0), F.regexp_extract_all(c, F.lit(r"(?U)\b[A-Z]{2,}\b"), 0))


def entity_root(e: Column) -> Column:
    """The last word of a name, letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(F.element_at(F.split(e, r"\s+"), -1), "[^A-Za-z0-9]", ""))


def _with(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns({f"__{k}": v for k, v in columns.items()})


def _drop(df: DataFrame) -> DataFrame:
    return df.drop(*(c for c in df.columns if c.startswith("__")))


def redundancy(df: DataFrame, text: str, near: float = 0.9, style: str = "C") -> DataFrame:
    """novel_sentence_ratio, near_dup_rate (neighbours whose 3-grams are alike), sentence lengths (mean, 95th percentile), densities and clauses."""
    r = _with(df, s=X.sentences(F.col(text), style), w=X.tokens(F.col(text)))
    s, w = F.col("__s"), F.col("__w")
    like = adjacent(F.transform(s, lambda x: X.char_grams(x, pad=False)), lambda a, b: F.when(X.jaccard(a, b, 1.0) >= near, 1).otherwise(0))
    low = F.transform(s, lambda x: F.lower(x))
    clauses = F.transform(low, lambda x: 1 + F.size(F.regexp_extract_all(x, F.lit(r"[,;]|(?U)\b(?:and|but|or|which|that)\b"), 0)))
    lengths = F.transform(s, lambda x: F.size(X.tokens(x)))
    density = over(F.size(F.filter(w, is_content)), F.size(w))
    return _drop(r.withColumns({
        "novel_sentence_ratio": over(F.size(F.array_distinct(low)), F.size(s)), "near_dup_rate": mean(like), "sent_len_avg": mean(lengths), "sent_len_p95": nearest_rank(lengths, 0.95),
        "lexical_density": density, "non_stopword_density": density, "filler_rate": over(F.size(F.filter(w, lambda x: x.isin(FILLERS))), F.size(w)), "avg_clauses": mean(clauses),
    }))


def overlap(df: DataFrame, text: str, style: str = "C") -> DataFrame:
    """How many entities and content words neighbouring sentences share: mean and lower quarter."""
    r = _with(df, s=X.sentences(F.col(text), style))
    named = F.transform(F.col("__s"), lambda x: F.array_distinct(F.transform(entities(x), entity_root)))
    words = F.transform(F.col("__s"), lambda x: F.array_distinct(F.transform(F.filter(X.tokens(x), is_content), X.lemma)))
    r = _with(r, e=named, c=words)
    r = _with(r, eo=adjacent(F.col("__e"), lambda a, b: X.jaccard(a, b, 1.0)), co=adjacent(F.col("__c"), lambda a, b: X.jaccard(a, b, 1.0)))
    eo, co = F.col("__eo"), F.col("__co")
    return _drop(r.withColumns({"ent_overlap_mean": mean(eo), "ent_overlap_p25": lower_quarter(eo), "content_overlap_mean": mean(co), "content_overlap_p25": lower_quarter(co)}))


def consistency(df: DataFrame, text: str, style: str = "C") -> DataFrame:
    """alias_switches (forms of an entity beyond the first, in 1,000 words), number_conflicts, temporal_violations."""
    r = _with(df, s=X.sentences(F.col(text), style), w=F.size(X.tokens(F.col(text))))
    s = F.col("__s")
    forms = F.array_distinct(F.flatten(F.transform(s, entities)))
    switches = F.size(forms) - F.size(F.array_distinct(F.transform(forms, entity_root)))
    counted = lambda x: F.transform(F.regexp_extract_all(x, F.lit(COUNTED), 0), lambda c: F.struct(X.lemma(F.regexp_extract(c, r"([A-Za-z][a-z\-]+)$", 1)).alias("noun"), F.regexp_replace(F.regexp_extract(c, r"^[0-9.,]+", 0), ",", "").cast("double").alias("n")))
    r = _with(r, n=F.transform(s, counted), y=F.transform(s, lambda x: F.transform(F.regexp_extract_all(x, F.lit(YEAR), 1), lambda y: y.cast("int"))), l=F.transform(s, lambda x: F.lower(x)))

    def conflicts(i: Column) -> Column:
        first = F.greatest(i - 2, F.lit(1))
        seen = F.array_distinct(F.flatten(F.slice("__n", first, i + 2 - first + 1)))
        nouns = F.transform(seen, lambda p: p["noun"])
        return F.size(F.filter(F.array_distinct(nouns), lambda n: F.size(F.filter(nouns, lambda m: m == n)) > 1))

    places = F.when(F.size(s) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(F.size(s), F.lit(1))))
    has = lambda x, words: F.coalesce(x.rlike("|".join(words)), F.lit(False))
    least, most = (lambda y: F.array_min(y)), (lambda y: F.array_max(y))
    one = lambda c: F.when(c, 1).otherwise(0)

    def neighbours(i: Column) -> Column:
        a, b, now, before = F.get("__y", i - 1), F.get("__y", i), F.get("__l", i), F.get("__l", i - 1)
        return one(F.contains(now, F.lit("later")) & (most(b) < least(a))) + one(F.contains(now, F.lit("earlier")) & (least(b) > most(a))) + one(has(now, ONWARD) & has(before, BACK))

    def carried(acc: Column, x: Column) -> Column:
        year = least(x["y"])
        wrong = one(F.contains(x["l"], F.lit("later")) & (year < acc["last"])) + one(F.contains(x["l"], F.lit("earlier")) & (year > acc["last"]))
        return F.struct(F.coalesce(year, acc["last"]).alias("last"), (acc["n"] + wrong).alias("n"))

    pairs = F.when(F.size(s) < 2, F.lit(0.0)).otherwise(total(F.transform(F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))), neighbours)))
    zipped = F.zip_with("__y", "__l", lambda y, low: F.struct(y.alias("y"), low.alias("l")))
    far = F.aggregate(zipped, F.struct(F.lit(None).cast("int").alias("last"), F.lit(0).alias("n")), carried, lambda acc: acc["n"])
    return _drop(r.withColumns({
        "alias_switches": 1000.0 * switches / F.greatest(F.col("__w"), F.lit(1)), "number_conflicts": total(F.transform(places, conflicts)).cast("long"), "temporal_violations": (pairs + far).cast("long"),
    }))


def structure(beats: DataFrame, run: str, text: str = "text", style: str = "C") -> DataFrame:
    """Per run: share of beats with text, spread of their lengths, shares that lead in and that conclude."""
    s = X.sentences(F.col(text), style)
    first, last = F.trim(F.get(s, F.lit(0))), F.lower(F.trim(F.element_at(s, -1)))
    leads = F.lower(first).rlike("^(in|on|at) ") | first.rlike(YEAR)
    ends = F.lit(False)
    for cue in CONCLUSIONS:
        ends = ends | F.contains(last, F.lit(cue))
    has = F.size(s) > 0
    rows = beats.select(run, F.size(X.tokens(F.col(text))).alias("n"), F.coalesce(F.trim(text) != "", F.lit(False)).alias("full"), (has & leads).alias("leads"), (has & ends).alias("ends"))
    share = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double"))
    out = rows.groupBy(run).agg(share("full").alias("non_empty"), F.collect_list("n").alias("lengths"), share("leads").alias("lead_rate"), share("ends").alias("conclude_rate"))
    return out.withColumn("length_spread", iqr_over_median(F.col("lengths"))).drop("lengths")


def topic_spread(beats: DataFrame, run: str, beat: str, text: str = "text") -> DataFrame:
    """Per run: topic_var, the mean pairwise distance of its beats, and beat_to_global, their mean likeness to all of it.

    Beats are unit vectors of term counts (over the largest) times smoothed inverse
    document frequency; beats without content words count as zero vectors.
    """
    every = beats.select(run, F.col(beat).alias("b"), F.filter(F.transform(X.tokens(F.col(text)), X.lemma), is_content).alias("w"))
    size = every.groupBy(run).agg(F.count("*").alias("beats"))
    tf = every.select(run, "b", F.explode("w").alias("t")).groupBy(run, "b", "t").agg(F.count("*").alias("c"))
    df = tf.groupBy(run, "t").agg(F.count("*").alias("df"), F.sum("c").alias("all"))
    idf = df.join(size, run).select(run, "t", (F.log((F.col("beats") + 1) / (F.col("df") + 1)) + 1).alias("idf"), "all")
    weighed = tf.join(idf, [run, "t"]).withColumn("x", F.col("c") * F.col("idf"))  # the largest count only scales
    norms = weighed.groupBy(run, "b").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    unit = weighed.join(norms, [run, "b"]).withColumn("v", F.col("x") / F.col("norm"))
    sums = unit.groupBy(run, "t").agg(F.sum("v").alias("v"), F.first("all").alias("all"))
    per = sums.groupBy(run).agg(F.sum(F.col("v") * F.col("v")).alias("square"), F.sum(F.col("v") * F.col("all")).alias("dot"), F.sqrt(F.sum(F.col("all") * F.col("all"))).alias("global"))
    filled = norms.groupBy(run).agg(F.count("*").alias("filled"))
    out = size.join(per, run, "left").join(filled, run, "left")
    pairs = F.col("beats") * (F.col("beats") - 1)
    var = F.when(F.col("filled").isNull() | (pairs == 0), 0.0).otherwise(1 - (F.col("square") - F.col("filled")) / pairs)
    return out.select(run, var.alias("topic_var"), F.coalesce(F.col("dot") / F.col("global") / F.col("beats"), F.lit(0.0)).alias("beat_to_global"))


def quality(df: DataFrame, text: str) -> DataFrame:
    """18 statistics of a text as columns, and ``checks``: a struct of 15 booleans."""
    t = F.coalesce(F.col(text), F.lit(""))
    paragraphs = F.filter(F.transform(F.split(t, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")
    r = _with(df, t=t, p=paragraphs, s=X.sentences(t), w=X.tokens(t), c=X.content_tokens(t))
    s, w, c = F.col("__s"), F.col("__w"), F.col("__c")
    grams = lambda n: F.when(F.size(c) < n, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - n + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(c, i, n))))
    r = _with(r, g2=F.sort_array(grams(2)), g3=F.sort_array(grams(3)), k=F.transform(s, lambda x: F.array_distinct(X.content_tokens(x))), y=F.transform(s, lambda x: F.transform(X.years(x), lambda y: y.cast("int"))))

    def repeated(name: str) -> Column:
        """Share of the distinct n-grams that occur twice: in the sorted array, each one's second place."""
        g = F.col(name)
        at = F.when(F.size(g) < 2, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(F.size(g) - 1, F.lit(1))))
        second = F.filter(at, lambda i: (F.get(g, i) == F.get(g, i - 1)) & ~F.coalesce(F.get(g, i - 1) == F.get(g, i - 2), F.lit(False)))
        return over(F.size(second), F.size(F.array_distinct(g)))

    r = _with(r, b2=repeated("__g2"), b3=repeated("__g3"))
    n = F.greatest(F.size(s), F.lit(1))
    padded = F.transform(s, lambda x: F.concat(F.lit(" "), F.lower(x), F.lit(" ")))
    bridges = F.filter(padded, lambda x: F.coalesce(F.array_contains(F.array(*(F.contains(x, F.lit(f" {b} ")) for b in BRIDGES)), True), F.lit(False)))
    alike = adjacent(F.col("__k"), lambda a, b: F.when(X.jaccard(a, b) >= 0.8, 1).otherwise(0))

    def carried(acc: Column, x: Column) -> Column:
        pair = F.size(acc["years"]).__gt__(0) & (F.size(x["y"]) > 0)
        back = pair & (F.array_max(x["y"]) < F.array_min(acc["years"])) & ~F.lower(x["s"]).rlike("|".join(BACKWARD))
        add = lambda cond: F.when(F.coalesce(cond, F.lit(False)), 1).otherwise(0)
        return F.struct(F.when(F.size(x["y"]) > 0, x["y"]).otherwise(acc["years"]).alias("years"), (acc["pairs"] + add(pair)).alias("pairs"), (acc["back"] + add(back)).alias("back"))

    start = F.struct(F.array().cast("array<int>").alias("years"), F.lit(0).alias("pairs"), F.lit(0).alias("back"))
    zipped = F.zip_with("__y", "__s", lambda y, x: F.struct(y.alias("y"), x.alias("s")))
    order = F.aggregate(zipped, start, carried, lambda a: F.when(a["pairs"] == 0, F.lit(1.0)).otherwise(1 - a["back"] / a["pairs"]))
    syllables = F.aggregate(w, F.lit(0), lambda a, x: a + X.syllables(x))
    single = F.size(F.filter("__p", lambda p: F.size(X.sentences(p)) == 1))
    line = lambda pattern: t.rlike(rf"(?m)^[^\S\n]*{pattern}[^\S\n]")
    out = r.withColumns({
        "paragraphs": F.size("__p"), "sentences": F.size(s), "avg_sent_len": over(total(F.transform(s, lambda x: F.size(X.content_tokens(x)))), F.size(s)), "flesch": X.flesch(F.size(s), F.size(w), syllables),
        "grade": X.grade(F.size(s), F.size(w), syllables), "type_token": F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1)), "content_ttr": F.size(F.array_distinct(c)) / F.greatest(F.size(c), F.lit(1)),
        "bigram_rep": F.col("__b2"), "trigram_rep": F.col("__b3"), "passive_rate": F.size(F.regexp_extract_all(t, F.lit(r"(?i)\b(?:was|were|is|are|been|being|be)\s+\w+ed\b"), 0)) / n,
        "bridge_rate": F.size(bridges) / n, "redundancy_rate": mean(alike), "temporal_consistency": order, "single_para_ratio": single / F.greatest(F.size("__p"), F.lit(1)),
        "bullets": line(r"[-*0-9]+"), "headings": line(r"#{1,6}"), "uris": t.rlike("https?://"), "instance_ids": t.rlike(r"\b(?:Membership_|lit::)"),
    })
    q = QUALITY
    checks = {
        "no_bullets": ~F.col("bullets"), "no_headings": ~F.col("headings"), "no_uris": ~F.col("uris"), "no_instance_ids": ~F.col("instance_ids"), "fre_min": F.col("flesch") >= q["fre_min"],
        "fkgl_max": F.col("grade") <= q["fkgl_max"], "avg_sent_len_band": F.col("avg_sent_len").between(q["avg_sent_len_min"], q["avg_sent_len_max"]),
        "single_sent_para_ratio_max": F.col("single_para_ratio") <= q["single_sent_para_ratio_max"], "bigram_rep_max": F.col("bigram_rep") <= q["bigram_rep_max"],
        "trigram_rep_max": F.col("trigram_rep") <= q["trigram_rep_max"], "passive_rate_max": F.col("passive_rate") <= q["passive_rate_max"],
        "bridge_rate_band": F.col("bridge_rate").between(q["bridge_rate_min"], q["bridge_rate_max"]), "redundancy_rate_max": F.col("redundancy_rate") <= q["redundancy_rate_max"],
        "temporal_consistency_min": F.col("temporal_consistency") >= q["temporal_consistency_min"], "content_ttr_min": F.col("content_ttr") >= q["content_ttr_min"],
    }
    return _drop(out.withColumn("checks", F.struct(*(v.alias(k) for k, v in checks.items()))))


def gated(rows: DataFrame) -> DataFrame:
    """``gate_pass`` and ``auto_score`` (0..100) from citation_rate, coverage, ungrounded, fact_density, continuity and style_violation."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    clean, grounded = ~F.col("style_violation"), F.col("ungrounded") == 0
    parts = [
        (0.30, F.least(F.lit(1.0), F.col("coverage"))), (0.30, F.least(F.lit(1.0), F.col("citation_rate")) * F.when(grounded, 1.0).otherwise(0.6)),
        (0.15, unit(1.5 - F.abs(F.col("fact_density") - 1.0))), (0.15, unit(F.col("continuity") / 0.6)), (0.10, F.when(clean, 1.0).otherwise(0.3)),
    ]
    score = sum((w * p for w, p in parts[1:]), parts[0][0] * parts[0][1])
    passed = (F.col("citation_rate") >= 0.8) & (F.col("coverage") >= 0.6) & grounded & clean
    return rows.withColumns({"gate_pass": passed.cast("int"), "auto_score": F.round(100 * score, 1)})


# --- support by other kinds of evidence ---


def candidate_gate(tfidf: Column, char3: Column, names: Column, nums: Column, years: Column, tf: float = 0.30, cj: float = 0.25) -> Column:
    """Whether a candidate is worth a closer look: like enough, or any name, number or year in common."""
    return (tfidf >= tf) | (char3 >= cj) | (names > 0) | (nums > 0) | (years > 0)


def lexical_support(like: Column, names: Column, nums: Column, years: Column, alone: float = 0.62, with_overlap: float = 0.45) -> Column:
    """The older rule: very like, or fairly like with a name, number or year in common."""
    return (like >= alone) | ((like >= with_overlap) & ((names > 0) | (nums > 0) | (years > 0)))


def plain(c: Column) -> Column:
    return X.squeeze(F.lower(F.coalesce(c, F.lit(""))))


def triple_support(sentences: DataFrame, facts: DataFrame, group: str) -> DataFrame:
    """``supported``: subject and object of some fact(group, s, o) both stand in the sentence."""
    f = facts.select(group, plain(F.col("s")).alias("fs"), plain(F.col("o")).alias("fo")).distinct()
    said = sentences.select(group, "pos", plain(F.col("text")).alias("said"))
    hits = said.join(f, group).filter(F.contains("said", F.col("fs")) & F.contains("said", F.col("fo"))).select(group, "pos").distinct().withColumn("supported", F.lit(True))
    return sentences.join(hits, [group, "pos"], "left").fillna(False, ["supported"])


def comention_support(sentences: DataFrame, names: DataFrame, group: str, least: int = 2) -> DataFrame:
    """``supported``: at least ``least`` distinct names(group, entity) of the evidence stand in the sentence."""
    n = names.select(group, F.lower("entity").alias("e")).filter("e <> ''").distinct().groupBy(group).agg(F.collect_set("e").alias("es"))
    said = sentences.join(n, group, "left")
    hits = F.size(F.filter(F.coalesce("es", F.array().cast("array<string>")), lambda e: F.contains(F.lower("text"), e)))
    return said.withColumn("supported", hits >= least).drop("es")


def evidence_mode(groups: DataFrame, factlets: DataFrame, facts: DataFrame, group: str) -> DataFrame:
    """``mode`` of each group: factlets where it has any, else triples, else fallback."""
    has = lambda df, n: df.select(group).distinct().withColumn(n, F.lit(True))
    marked = groups.join(has(factlets, "__f"), group, "left").join(has(facts, "__t"), group, "left")
    return marked.withColumn("mode", F.when(F.col("__f"), "factlets").when(F.col("__t"), "triples").otherwise("fallback")).drop("__f", "__t")


def cascade(sentences: DataFrame, factlet_flags: DataFrame, triple_flags: DataFrame, fallback_flags: DataFrame, modes: DataFrame, group: str) -> DataFrame:
    """Per sentence the flag of the mode that its group has; flags are (group, pos, supported)."""
    out = sentences.select(group, "pos").join(modes.select(group, "mode"), group)
    for name, flags in (("factlets", factlet_flags), ("triples", triple_flags), ("fallback", fallback_flags)):
        out = out.join(flags.select(group, "pos", F.col("supported").alias(f"__{name}")), [group, "pos"], "left")
    pick = F.when(F.col("mode") == "factlets", F.col("__factlets")).when(F.col("mode") == "triples", F.col("__triples")).otherwise(F.col("__fallback"))
    return out.select(group, "pos", "mode", F.coalesce(pick, F.lit(False)).alias("supported"))


# Names too general to anchor a sentence.
GENERAL_NAMES = ["United", "Kingdom", "United Kingdom", "United States", "Global", "Broadcast", "Event", "City", "Stadium", "Arena", "Festival"]


def parenthetical(evidence: Column, sentence: Column) -> Column:
    """The longest name of the evidence and its first year (else number) that the sentence lacks; else two of its words; empty if none."""
    used = X.tokens(sentence)
    fresh = lambda a: F.filter(a, lambda x: ~F.array_contains(used, F.lower(x)))
    names = F.filter(fresh(X.proper_nouns(evidence)), lambda x: ~x.isin(GENERAL_NAMES))
    best = F.aggregate(names, F.lit(""), lambda a, x: F.when(F.struct(F.size(F.split(x, r"\s+")), F.length(x)) > F.struct(F.when(a == "", 0).otherwise(F.size(F.split(a, r"\s+"))), F.length(a)), x).otherwise(a))
    years = X.years(evidence)
    numbers = F.filter(X.numbers(evidence), lambda x: ~F.array_contains(years, x))
    number = F.coalesce(F.get(fresh(years), F.lit(0)), F.get(fresh(numbers), F.lit(0)), F.lit(""))
    found = F.filter(F.array(best, number), lambda x: x != "")
    words = F.slice(F.sort_array(F.array_distinct(F.filter(fresh(X.tokens(evidence)), lambda x: F.length(x) > 2))), 1, 2)
    return F.array_join(F.when(F.size(found) > 0, found).otherwise(words), ", ")


def patched(matched: DataFrame, group: str, most: int = 2) -> DataFrame:
    """``matched(group, pos, text, evidence)`` with ``fixed``: the first ``most`` sentences of a group that share under two words with their evidence get its parenthetical."""
    few = F.size(F.array_intersect(X.tokens(F.col("text")), X.tokens(F.col("evidence")))) < 2
    note = parenthetical(F.col("evidence"), F.col("text"))
    rows = matched.withColumn("__note", F.when((F.coalesce("evidence", F.lit("")) != "") & few, note).otherwise(F.lit(""))).withColumn("__due", (F.col("__note") != "").cast("int"))
    nth = F.sum("__due").over(Window.partitionBy(group).orderBy("pos"))
    stem = F.regexp_replace("text", r"[.!?]$", "")
    return rows.withColumn("fixed", F.when((F.col("__due") == 1) & (nth <= most), F.concat(stem, F.lit(" ("), "__note", F.lit(").")))
                           .otherwise(F.col("text"))).drop("__note", "__due")
