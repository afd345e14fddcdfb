"""Metrics of texts, structure of runs and kinds of evidence on the document and conversation tables, with SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import metrics as M
from graphloom.operators.narrative import BRIDGES
from graphloom.queries.text import sents, toks
from graphloom.sources.star import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _words(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_ALPHA = f"(regexp_full_match(x, '[a-z]+') AND NOT list_contains({_words(M.FUNCTION_WORDS)}, x))"
_SHARE = "CASE WHEN {d} = 0 THEN 0.0 ELSE CAST({n} AS DOUBLE) / {d} END"


def _share(n: str, d: str) -> str:
    return _SHARE.format(n=n, d=d)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


_JACCARD = "CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN {empty} ELSE CAST(len(list_intersect({a}, {b})) AS DOUBLE) / len(list_distinct(list_concat({a}, {b}))) END"


@query(
    f"""WITH d AS (SELECT doc_id, {sents('text')} AS s, {toks("coalesce(text, '')")} AS w FROM documents),
    l AS (SELECT *, list_transform(s, lambda x: len({toks('x')})) AS n, list_transform(s, lambda x: lower(x)) AS low FROM d)
    SELECT doc_id, round({_share('len(list_distinct(low))', 'len(s)')}, 6) AS novel_sentence_ratio,
      round({_share('list_sum(n)', 'len(s)')}, 6) AS sent_len_avg, coalesce(CAST(list_sort(n)[CAST(ceil(0.95 * len(n)) AS INT)] AS DOUBLE), 0.0) AS sent_len_p95,
      round({_share(f'len(list_filter(w, lambda x: {_ALPHA}))', 'len(w)')}, 6) AS lexical_density, round({_share(f'len(list_filter(w, lambda x: list_contains({_words(M.FILLERS)}, x)))', 'len(w)')}, 6) AS filler_rate FROM l"""
)
def narrative_redundancy(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = M.redundancy(docs, "text", style="A").drop("text", "near_dup_rate", "non_stopword_density", "avg_clauses")
    return _rounded(out, "novel_sentence_ratio", "sent_len_avg", "lexical_density", "filler_rate")


@query()
def narrative_overlap(spark, d):
    return _rounded(M.overlap(table(spark, d, "documents").select("doc_id", "text"), "text").drop("text"), "ent_overlap_mean", "ent_overlap_p25", "content_overlap_mean", "content_overlap_p25")


@query()
def narrative_consistency(spark, d):
    return _rounded(M.consistency(table(spark, d, "documents").select("doc_id", "text"), "text").drop("text"), "alias_switches")


@query(
    f"""WITH b AS (SELECT conv_id, len({toks("coalesce(text, '')")}) AS n, CASE WHEN text IS NOT NULL AND trim(text) <> '' THEN 1.0 ELSE 0.0 END AS full_, {sents('text')} AS s FROM conversations),
    e AS (SELECT conv_id, n, full_, len(s) > 0 AND (regexp_matches(lower(s[1]), '^(in|on|at) ') OR regexp_matches(s[1], '\\b(1[89][0-9]{{2}}|20[0-9]{{2}})\\b')) AS leads,
      len(s) > 0 AND ({" OR ".join(f"contains(lower(s[len(s)]), '{c}')" for c in M.CONCLUSIONS)}) AS ends FROM b),
    g AS (SELECT conv_id, avg(full_) AS f, count(*) AS k, quantile_cont(n, 0.25) AS q1, median(n) AS q2, quantile_cont(n, 0.75) AS q3, avg(CASE WHEN leads THEN 1.0 ELSE 0.0 END) AS l, avg(CASE WHEN ends THEN 1.0 ELSE 0.0 END) AS c FROM e GROUP BY 1)
    SELECT conv_id, round(f, 6) AS non_empty, round(l, 6) AS lead_rate, round(c, 6) AS conclude_rate, round(CASE WHEN k < 2 THEN 0.0 ELSE (q3 - q1) / (CASE WHEN q2 = 0 THEN 1.0 ELSE q2 END) END, 6) AS length_spread FROM g"""
)
def structure_metrics(spark, d):
    return _rounded(M.structure(table(spark, d, "conversations"), "conv_id", style="A"), "non_empty", "lead_rate", "conclude_rate", "length_spread")


def _stemmed(x: str) -> str:
    cut = lambda k: f"left({x}, length({x}) - {k})"
    return f"CASE WHEN {x} LIKE '%ing' AND length({x}) > 5 THEN {cut(3)} WHEN {x} LIKE '%ed' AND length({x}) > 4 THEN {cut(2)} WHEN {x} LIKE '%es' AND length({x}) > 4 THEN {cut(2)} WHEN {x} LIKE '%s' AND length({x}) > 3 THEN {cut(1)} ELSE {x} END"


@query(
    f"""WITH b AS (SELECT conv_id, turn, unnest({toks("coalesce(text, '')")}) AS w FROM conversations), k AS (SELECT conv_id, count(*) AS beats FROM conversations GROUP BY 1),
    t0 AS (SELECT conv_id, turn, {_stemmed("regexp_replace(w, '''s$', '')")} AS x FROM b), t AS (SELECT conv_id, turn, x, count(*) AS c FROM t0 WHERE {_ALPHA} GROUP BY 1, 2, 3),
    f AS (SELECT conv_id, x, count(*) AS df, sum(c) AS every FROM t GROUP BY 1, 2), w AS (SELECT t.conv_id, turn, x, c * (ln((beats + 1.0) / (df + 1.0)) + 1) AS v, every FROM t JOIN f USING (conv_id, x) JOIN k USING (conv_id)),
    u AS (SELECT conv_id, turn, x, every, v / sqrt(sum(v * v) OVER (PARTITION BY conv_id, turn)) AS v FROM w),
    p AS (SELECT a.conv_id, a.turn AS i, b.turn AS j, sum(a.v * b.v) AS c FROM u a JOIN u b ON a.conv_id = b.conv_id AND a.x = b.x AND a.turn < b.turn GROUP BY 1, 2, 3), s AS (SELECT conv_id, sum(c) AS c FROM p GROUP BY 1),
    g AS (SELECT conv_id, sum(v * every) AS dot FROM u GROUP BY 1), n AS (SELECT conv_id, sqrt(sum(every * every)) AS size FROM f GROUP BY 1)
    SELECT k.conv_id, round(CASE WHEN beats < 2 OR size IS NULL THEN 0.0 ELSE 1 - 2 * coalesce(c, 0.0) / (beats * (beats - 1.0)) END, 6) AS topic_var, round(coalesce(dot / size / beats, 0.0), 6) AS beat_to_global
    FROM k LEFT JOIN s USING (conv_id) LEFT JOIN g USING (conv_id) LEFT JOIN n USING (conv_id)"""
)
def topic_spread(spark, d):
    return _rounded(M.topic_spread(table(spark, d, "conversations"), "conv_id", "turn"), "topic_var", "beat_to_global")


_CT = "list_filter(list_transform(regexp_extract_all({t}, '[A-Za-z][A-Za-z\\-'']+'), lambda x: lower(x)), lambda x: NOT list_contains(" + _words(X.STOPWORDS) + ", x))"


@query(
    f"""WITH d AS (SELECT conv_id, turn, text, {sents('text')} AS s, {toks("coalesce(text, '')")} AS w, {_CT.format(t="coalesce(text, '')")} AS c FROM conversations),
    e AS (SELECT *, list_transform(s, lambda x: ' ' || lower(x) || ' ') AS padded, list_transform(s, lambda x: list_distinct({_CT.format(t='x')})) AS k,
      list_transform(range(1, len(c)), lambda i: c[i] || ' ' || c[i + 1]) AS g2, list_transform(range(1, len(c) - 1), lambda i: c[i] || ' ' || c[i + 1] || ' ' || c[i + 2]) AS g3 FROM d),
    h AS (SELECT conv_id, turn, len(s) AS sentences, {_share('list_sum(list_transform(s, lambda x: len(' + _CT.format(t='x') + ')))', 'len(s)')} AS avg_sent_len,
      len(list_distinct(c)) / greatest(CAST(len(c) AS DOUBLE), 1) AS content_ttr, coalesce(len(list_filter(map_values(list_histogram(g2)), lambda v: v >= 2)), 0) / greatest(CAST(len(list_distinct(g2)) AS DOUBLE), 1) AS bigram_rep,
      coalesce(len(list_filter(map_values(list_histogram(g3)), lambda v: v >= 2)), 0) / greatest(CAST(len(list_distinct(g3)) AS DOUBLE), 1) AS trigram_rep,
      len(list_filter(padded, lambda x: {" OR ".join(f"contains(x, ' {b} ')" for b in BRIDGES)})) / greatest(CAST(len(s) AS DOUBLE), 1) AS bridge_rate,
      CASE WHEN len(s) < 2 THEN 0.0 ELSE list_avg(list_transform(range(1, len(s)), lambda i: CASE WHEN {_JACCARD.format(a='k[i]', b='k[i + 1]', empty='0.0')} >= 0.8 THEN 1.0 ELSE 0.0 END)) END AS redundancy_rate,
      regexp_matches(coalesce(text, ''), '(?m)^[ \\t\\r\\f\\v]*#{{1,6}}[ \\t\\r\\f\\v]') AS headings, regexp_matches(coalesce(text, ''), 'https?://') AS uris FROM e)
    SELECT conv_id, turn, CAST(sentences AS INT) AS sentences, round(avg_sent_len, 6) AS avg_sent_len, round(content_ttr, 6) AS content_ttr, round(bigram_rep, 6) AS bigram_rep, round(trigram_rep, 6) AS trigram_rep, round(bridge_rate, 6) AS bridge_rate,
      round(redundancy_rate, 6) AS redundancy_rate, headings, uris, bridge_rate BETWEEN 0.15 AND 0.60 AS bridge_ok, bigram_rep <= 0.25 AND trigram_rep <= 0.15 AND redundancy_rate <= 0.20 AND content_ttr >= 0.35 AS variety_ok FROM h"""
)
def quality_checks(spark, d):
    q = M.quality(table(spark, d, "conversations").select("conv_id", "turn", "text"), "text")
    ok = [F.col("checks")[c] for c in ("bigram_rep_max", "trigram_rep_max", "redundancy_rate_max", "content_ttr_min")]
    out = q.select(
        "conv_id", "turn", "sentences", "avg_sent_len", "content_ttr", "bigram_rep", "trigram_rep", "bridge_rate", "redundancy_rate", "headings", "uris",
        F.col("checks.bridge_rate_band").alias("bridge_ok"), (ok[0] & ok[1] & ok[2] & ok[3]).alias("variety_ok"),
    )
    return _rounded(out, "avg_sent_len", "content_ttr", "bigram_rep", "trigram_rep", "bridge_rate", "redundancy_rate")


_GATE = {"citation_rate": "(o_orderkey % 11) / 10.0", "coverage": "(o_custkey % 13) / 12.0", "fact_density": "(o_orderkey % 30) / 10.0", "continuity": "(o_custkey % 7) / 10.0"}


@query(
    """WITH r AS (SELECT o_orderkey, least(1.0, coverage) AS a, least(1.0, citation_rate) * (CASE WHEN ungrounded = 0 THEN 1.0 ELSE 0.6 END) AS b, greatest(0.0, least(1.0, 1.5 - abs(fact_density - 1.0))) AS c,
      greatest(0.0, least(1.0, continuity / 0.6)) AS e, CASE WHEN style THEN 0.3 ELSE 1.0 END AS f, citation_rate >= 0.8 AND coverage >= 0.6 AND ungrounded = 0 AND NOT style AS g
      FROM (SELECT o_orderkey, o_orderkey % 3 AS ungrounded, o_orderstatus = 'P' AS style, """
    + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in _GATE.items())
    + """ FROM orders)) SELECT o_orderkey, CAST(g AS INT) AS gate_pass, round(100 * (0.30 * a + 0.30 * b + 0.15 * c + 0.15 * e + 0.10 * f), 1) AS auto_score FROM r"""
)
def gate_and_score(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 3).alias("ungrounded"), (F.col("o_orderstatus") == "P").alias("style_violation"), *(F.expr(f"CAST({e} AS DOUBLE)").alias(n) for n, e in _GATE.items()))
    return M.gated(rows).select("o_orderkey", "gate_pass", "auto_score")


def _talk(spark, d, role):
    return table(spark, d, "conversations").filter(F.col("role") == role).select("conv_id", F.col("turn").alias("pos"), "text")


def _facts(spark, d):
    """First and last content word of each user line as a fact."""
    c = X.content_tokens(F.col("text"))
    return _talk(spark, d, "user").withColumn("c", c).filter(F.size("c") > 1).select("conv_id", F.get("c", F.lit(0)).alias("s"), F.element_at("c", -1).alias("o"))


_FACTS = f"f AS (SELECT conv_id, c[1] AS s, c[len(c)] AS o FROM (SELECT conv_id, {_CT.format(t='text')} AS c FROM conversations WHERE role = 'user') WHERE len(c) > 1)"
_SAID = r"a AS (SELECT conv_id, turn AS pos, trim(regexp_replace(lower(coalesce(text, '')), '[ \t\n\r\f\v]+', ' ', 'g')) AS said FROM conversations WHERE role = 'assistant')"
_TRIPLES = "t AS (SELECT a.conv_id, a.pos, coalesce(bool_or(contains(said, s) AND contains(said, o)), false) AS supported FROM a LEFT JOIN f USING (conv_id) GROUP BY 1, 2)"
_NAMES = "m AS (SELECT conv_id, s AS e FROM f UNION SELECT conv_id, o FROM f), c AS (SELECT a.conv_id, a.pos, coalesce(sum(CASE WHEN contains(said, e) THEN 1 ELSE 0 END), 0) >= 2 AS supported FROM a LEFT JOIN m USING (conv_id) GROUP BY 1, 2)"


@query(f"WITH {_FACTS}, {_SAID}, {_TRIPLES} SELECT conv_id, pos, supported FROM t")
def triple_support(spark, d):
    return M.triple_support(_talk(spark, d, "assistant"), _facts(spark, d), "conv_id").select("conv_id", "pos", "supported")


@query(f"WITH {_FACTS}, {_SAID}, {_NAMES} SELECT conv_id, pos, supported FROM c")
def comention_support(spark, d):
    f = _facts(spark, d)
    names = f.select("conv_id", F.col("s").alias("entity")).unionByName(f.select("conv_id", F.col("o").alias("entity")))
    return M.comention_support(_talk(spark, d, "assistant"), names, "conv_id").select("conv_id", "pos", "supported")


@query(
    f"""WITH {_FACTS}, {_SAID}, {_TRIPLES}, {_NAMES}, g AS (SELECT DISTINCT conv_id FROM a), md AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 AND conv_id IN (SELECT conv_id FROM f) THEN 'factlets' WHEN conv_id IN (SELECT conv_id FROM f) THEN 'triples' ELSE 'fallback' END AS mode FROM g)
    SELECT a.conv_id, a.pos, mode, CASE mode WHEN 'factlets' THEN c.supported WHEN 'triples' THEN t.supported ELSE false END AS supported FROM a JOIN md USING (conv_id) JOIN t ON t.conv_id = a.conv_id AND t.pos = a.pos JOIN c ON c.conv_id = a.conv_id AND c.pos = a.pos"""
)
def evidence_cascade(spark, d):
    """Conversations whose number divides by three count as having factlets; the flags of the modes are co-mention, triples and none."""
    said, facts = _talk(spark, d, "assistant"), _facts(spark, d)
    modes = M.evidence_mode(said.select("conv_id").distinct(), facts.filter("conv_id % 3 = 0"), facts, "conv_id")
    flags = lambda f: f(spark, d)
    return M.cascade(said, flags(comention_support), flags(triple_support), said.withColumn("supported", F.lit(False)), modes, "conv_id")
