"""Narrative scores and planning reports on the document tables, with SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import narrative, planning
from graphloom.queries.text import sents
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


_ROWS = f"s AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS text FROM (SELECT doc_id, {sents('text')} AS s FROM documents))"
_CONTENT = "list_filter(list_transform(regexp_extract_all({t}, '[A-Za-z][A-Za-z\\-'']+'), lambda w: lower(w)), lambda w: NOT list_contains(string_split('" + " ".join(X.STOPWORDS) + "', ' '), w))"


def _rows(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "text"))


@query(
    f"""WITH {_ROWS}, t AS (SELECT doc_id, pos, list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS w FROM s), p AS (SELECT doc_id, w, lag(w) OVER (PARTITION BY doc_id ORDER BY pos) AS q FROM t),
    j AS (SELECT doc_id, CASE WHEN q IS NULL THEN NULL WHEN len(list_distinct(list_concat(w, q))) = 0 THEN 0.0 ELSE CAST(len(list_intersect(w, q)) AS DOUBLE) / len(list_distinct(list_concat(w, q))) END AS j FROM p)
    SELECT doc_id, round(coalesce(avg(CASE WHEN j BETWEEN 0.15 AND 0.65 THEN 1.0 WHEN j IS NOT NULL THEN 0.0 END), 1.0), 9) AS local_band FROM j GROUP BY 1"""
)
def local_band(spark, d):
    return narrative.local_band(_rows(spark, d), "doc_id").withColumn("local_band", F.round("local_band", 9))


_HIT = " OR ".join(f"contains(' ' || lower(text) || ' ', ' {w} ')" for w in narrative.BRIDGES)


@query(f"WITH {_ROWS} SELECT doc_id, round((least(0.6, greatest(0.2, avg(CASE WHEN {_HIT} THEN 1.0 ELSE 0.0 END))) - 0.2) / 0.4, 9) AS bridge_rate FROM s GROUP BY 1")
def bridge_rate(spark, d):
    return narrative.bridge_rate(_rows(spark, d), "doc_id").withColumn("bridge_rate", F.round("bridge_rate", 9))


@query(
    f"""WITH orders_text AS (SELECT o_custkey AS doc_id, string_agg('Order of ' || year(o_orderdate) || CASE WHEN o_orderkey % 5 = 0 THEN ' earlier' ELSE '' END || '.', ' ' ORDER BY o_orderkey) AS text FROM orders GROUP BY 1), {_ROWS.replace('documents', 'orders_text')},
    y AS (SELECT doc_id, pos, text, CAST(regexp_extract(text, '\\b((19|20)\\d\\d)\\b', 1) AS INT) AS y FROM s), k AS (SELECT *, lag(y) OVER (PARTITION BY doc_id ORDER BY pos) AS known FROM y)
    SELECT doc_id, round(CASE WHEN count(known) = 0 THEN 1.0 ELSE 1 - CAST(sum(CASE WHEN y < known AND NOT contains(text, 'earlier') THEN 1 ELSE 0 END) AS DOUBLE) / count(known) END, 9) AS temporal FROM k GROUP BY 1"""
)
def temporal_consistency(spark, d):
    said = F.concat(F.lit("Order of "), F.year("o_orderdate"), F.when(F.col("o_orderkey") % 5 == 0, " earlier").otherwise(""), F.lit("."))
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pos"), said.alias("text"))
    return narrative.temporal_consistency(rows, "doc_id").withColumn("temporal", F.round("temporal", 9))


def _talk(spark, d, role):
    return table(spark, d, "conversations").filter(F.col("role") == role).select("conv_id", F.col("turn").alias("pos"), "text")


_FACT = f"""q AS (SELECT conv_id, turn AS pos, list_distinct({_CONTENT.format(t='text')}) AS st FROM conversations WHERE role = 'assistant'), f AS (SELECT conv_id, list_distinct({_CONTENT.format(t='text')}) AS ft FROM conversations WHERE role = 'user'),
  p AS (SELECT q.conv_id, q.pos, max(CASE WHEN len(list_intersect(st, ft)) >= 2 AND CAST(len(list_intersect(st, ft)) AS DOUBLE) / len(list_distinct(list_concat(st, ft))) >= 0.22 THEN 1 ELSE 0 END) AS m FROM q JOIN f USING (conv_id) GROUP BY 1, 2)"""


@query(f"WITH {_FACT} SELECT conv_id, q.pos, coalesce(m, 0) = 1 AS supported FROM q LEFT JOIN p USING (conv_id, pos)")
def factlet_support(spark, d):
    return narrative.factlet_support(_talk(spark, d, "assistant"), _talk(spark, d, "user"), "conv_id").select("conv_id", "pos", "supported")


@query(
    f"""WITH q AS (SELECT conv_id, list_distinct({_CONTENT.format(t='text')}) AS tt FROM (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY 1)),
    f AS (SELECT conv_id, list_distinct({_CONTENT.format(t='text')}) AS ft FROM conversations WHERE role = 'user') SELECT conv_id, round(avg(CASE WHEN len(list_intersect(tt, ft)) >= 2 THEN 1.0 ELSE 0.0 END), 9) AS coverage FROM q JOIN f USING (conv_id) GROUP BY 1"""
)
def factlet_coverage(spark, d):
    said = _talk(spark, d, "assistant").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text"))
    return narrative.factlet_coverage(said, _talk(spark, d, "user"), "conv_id").withColumn("coverage", F.round("coverage", 9))


@query(
    r"""WITH a AS (SELECT conv_id, turn AS pos, trim(regexp_replace(lower(text), '[ \t\n\r\f\v]+', ' ', 'g')) AS x FROM conversations WHERE role = 'assistant'), b AS (SELECT conv_id, turn AS pos, trim(regexp_replace(lower(text), '[ \t\n\r\f\v]+', ' ', 'g')) AS x FROM conversations WHERE role = 'user'),
    s AS (SELECT *, regexp_extract_all(x, '[a-z0-9'']+') AS w FROM a), e AS (SELECT *, regexp_extract_all(x, '[a-z0-9'']+') AS w FROM b), p0 AS (SELECT s.conv_id, s.pos AS sp, e.pos AS ep, s.x AS sx, e.x AS ex, s.w AS sw, e.w AS ew, least(3, len(s.w), len(e.w)) AS k FROM s JOIN e USING (conv_id) WHERE len(e.w) > 0),
    p AS (SELECT conv_id, sp, ep, CASE WHEN contains(sx, ex) OR CAST(len(list_intersect(list_distinct(sw), list_distinct(ew))) AS DOUBLE) / len(list_distinct(list_concat(sw, ew))) >= 0.38
      OR (k > 0 AND list_has_any(list_transform(range(1, len(sw) - k + 2), lambda i: array_to_string(sw[i:i + k - 1], ' ')), list_transform(range(1, len(ew) - k + 2), lambda i: array_to_string(ew[i:i + k - 1], ' ')))) THEN 1 ELSE 0 END AS hit FROM p0),
    c AS (SELECT conv_id, avg(h) AS coverage FROM (SELECT conv_id, ep, max(hit) AS h FROM p GROUP BY 1, 2) GROUP BY 1), u AS (SELECT conv_id, avg(h) AS support FROM (SELECT conv_id, sp, max(hit) AS h FROM p GROUP BY 1, 2) GROUP BY 1)
    SELECT conv_id, round(coverage, 9) AS coverage, round(support, 9) AS support FROM c JOIN u USING (conv_id)"""
)
def aligned_evidence(spark, d):
    out = narrative.aligned(_talk(spark, d, "assistant"), _talk(spark, d, "user"), "conv_id")
    return out.withColumns({c: F.round(c, 9) for c in ("coverage", "support")})


_BANDS = {"flesch": "o_totalprice / 5000.0", "entity_overlap": "(o_orderkey % 40) / 100.0", "content_overlap": "(o_orderkey % 17) / 100.0", "distinct_2": "(o_custkey % 60) / 100.0", "trigram_repetition": "(o_custkey % 11) / 100.0", "violations_per_1k": "CAST(o_orderkey % 3 AS DOUBLE)"}


def _scaled(m: str) -> str:
    low, high = narrative.NQI_BANDS[m]
    return f"round(least(100.0, greatest(0.0, 100.0 * (CAST({_BANDS[m]} AS DOUBLE) - {low}) / ({high} - {low}))), 1)"


@query("SELECT o_orderkey, round(" + " + ".join(_scaled(m) for m in _BANDS) + ", 1) AS nqi_sum FROM orders")
def nqi_lite(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", *(F.expr(f"CAST({e} AS DOUBLE)").alias(m) for m, e in _BANDS.items()))
    scored = narrative.nqi_lite(rows)
    return scored.select("o_orderkey", F.round(sum((F.col(f"{m}_score") for m in _BANDS), F.lit(0.0)), 1).alias("nqi_sum"))


@query("SELECT c_mktsegment, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r = 1")
def best_setting(spark, d):
    return narrative.best_setting(table(spark, d, "customer").select("c_mktsegment", "c_custkey", "c_acctbal"), "c_mktsegment", "c_acctbal", ["c_custkey"])


@query(
    """WITH n AS (SELECT l_orderkey AS run, l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY n DESC, k) AS r FROM n),
    a AS (SELECT run, sum(n) AS refs, count(*) AS d, sum(CASE WHEN r <= 3 THEN n ELSE 0 END) AS top3 FROM t GROUP BY 1), w AS (SELECT l_orderkey AS run, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS web FROM lineitem GROUP BY 1)
    SELECT run, CAST(refs AS BIGINT) AS refs, d AS distinct_refs, round(CAST(d AS DOUBLE) / refs, 9) AS unique_share, round(CAST(top3 AS DOUBLE) / refs, 9) AS top3_share, round(web, 9) AS web_share FROM a JOIN w USING (run)"""
)
def evidence_diversity(spark, d):
    refs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_suppkey").alias("k"), F.when(F.col("l_returnflag") == "R", "web").otherwise("kg").alias("kind"))
    out = narrative.diversity(refs, "run", "k", "kind")
    return out.withColumns({c: F.round(c, 9) for c in ("unique_share", "top3_share", "web_share")})


@query("SELECT count(*) AS total, CAST(sum(CASE WHEN text IS NULL OR trim(text) = '' THEN 1 ELSE 0 END) AS BIGINT) AS missing_text, CAST(sum(CASE WHEN role IS NULL OR trim(role) = '' THEN 1 ELSE 0 END) AS BIGINT) AS missing_role FROM conversations")
def index_report(spark, d):
    return planning.index_report(table(spark, d, "conversations"), ["text", "role"])


@query(
    r"""SELECT role, count(*) AS n, round(avg(length(text)), 6) AS mean_length, arg_min(line, (length(text), line)) AS preview FROM (SELECT role, text, substr(string_split(trim(text), chr(10))[1], 1, 200) AS line FROM conversations) GROUP BY 1"""
)
def query_manifest(spark, d):
    return planning.manifest(table(spark, d, "conversations"), "role", "text")


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6")
def common_titles(spark, d):
    return planning.common_titles(table(spark, d, "documents"), "source", 6)


@query(
    """WITH b AS (SELECT l_orderkey, l_partkey, 0 AS kind FROM lineitem WHERE l_returnflag = 'N' UNION ALL SELECT l_orderkey, l_partkey, 1 FROM lineitem), f AS (SELECT l_orderkey, l_partkey, min(kind) AS kind FROM b GROUP BY 1, 2)
    SELECT l_orderkey, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY kind, l_partkey) AS INT) AS n FROM f"""
)
def references_numbered(spark, d):
    lines = table(spark, d, "lineitem")
    return planning.references(lines.filter("l_returnflag = 'N'"), lines, "l_orderkey", "l_partkey").select("l_orderkey", "l_partkey", "n")


@query(
    f"""WITH s AS (SELECT conv_id, turn, unnest({sents('text')}) AS sentence FROM conversations WHERE role = 'assistant'), t AS (SELECT conv_id, count(DISTINCT sentence) AS n FROM s GROUP BY 1),
    v AS (SELECT DISTINCT conv_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]{{6,}}'))) AS value FROM conversations WHERE role = 'user'), m AS (SELECT DISTINCT s.conv_id, sentence FROM s JOIN v ON s.conv_id = v.conv_id AND contains(lower(sentence), value))
    SELECT t.conv_id, n, count(m.sentence) AS matched FROM t LEFT JOIN m ON m.conv_id = t.conv_id GROUP BY 1, 2"""
)
def facts_trace(spark, d):
    said, heard = _talk(spark, d, "assistant"), _talk(spark, d, "user")
    values = heard.select("conv_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), 0)).alias("value")).withColumn("value", F.lower("value"))
    trace = planning.facts_trace(said, values, "conv_id")
    n = said.select("conv_id", F.explode(X.sentences(F.col("text"))).alias("s")).groupBy("conv_id").agg(F.count_distinct("s").alias("n"))
    return n.join(trace.groupBy("conv_id").agg(F.count_distinct("sentence").alias("matched")), "conv_id", "left").fillna(0, ["matched"])


@query("SELECT o_custkey AS k, 'right' AS missing_in FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY 1 UNION ALL SELECT c_custkey, 'left' FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)")
def set_coverage(spark, d):
    left = table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return planning.set_coverage(left, table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k")), "k")


@query()
def cohesion_scores(spark, d):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = table(spark, d, "documents").select("doc_id", "text").filter("doc_id IS NOT NULL").repartition(n, "doc_id")  # a file may be one task
    rows = docs.select("doc_id", X.sentences(F.col("text")).alias("said"), F.array_distinct(X.proper_nouns(F.col("text"))).alias("names"))
    return narrative.cohesion_of(rows.filter(F.size("said") > 0), "doc_id")
