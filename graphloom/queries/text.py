"""Text, evaluation, retrieval and web queries on the document tables, with SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import sequential
from graphloom.functions import text as X
from graphloom.functions import variants, web
from graphloom.operators import evaluate, leaders, retrieve, search, vectors
from graphloom.operators.lineage import cut, scratch
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


SENTS = r"list_filter(list_transform(string_split(regexp_replace(trim({t}, chr(32)), '([.!?])[ \t\n\r\f\v]+', '\1' || chr(31), 'g'), chr(31)), lambda x: trim(x, chr(32))), lambda x: x <> '')"
TOKS = "regexp_extract_all(lower({t}), '[a-z0-9'']+')"


def sents(t: str) -> str:
    return SENTS.format(t=t)


def toks(t: str) -> str:
    return TOKS.format(t=t)


@query(f"SELECT doc_id, CAST(len(s) AS BIGINT) AS n, s[1] AS first_sentence FROM (SELECT doc_id, {sents('text')} AS s FROM documents)")
def sentence_split(spark, d):
    s = table(spark, d, "documents").select("doc_id", X.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("bigint").alias("n"), F.get("s", F.lit(0)).alias("first_sentence"))


@query(f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({toks('text')}) AS token FROM documents) GROUP BY 1")
def token_counts(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.explode(X.tokens(F.col("text"))).alias("token"))
    per = words.groupBy("token", "doc_id").agg(F.count("*").alias("k"))
    return per.groupBy("token").agg(F.sum("k").alias("n"), F.count("*").alias("docs"))


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '_', 'g'), '\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3})\b'), '|') AS names FROM documents")
def proper_nouns(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.array_join(X.proper_nouns(F.col("text")), "|").alias("names"))


@query(r"SELECT conv_id, turn, array_to_string(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '_', 'g'), '\b\d[\d,\.]*\b'), '|') AS nums, array_to_string(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '_', 'g'), '\b(19|20)\d{2}\b'), '|') AS years FROM conversations")
def numbers_years(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.array_join(X.numbers(F.col("text")), "|").alias("nums"), F.array_join(X.years(F.col("text")), "|").alias("years"))


@query(
    f"""SELECT doc_id, CAST(len(list_distinct(w)) AS DOUBLE) / len(w) AS ttr, CAST(len(w) AS BIGINT) AS n FROM (SELECT doc_id, {toks('text')} AS w FROM documents) WHERE len(w) > 0"""
)
def ttr(spark, d):
    w = table(spark, d, "documents").select("doc_id", X.tokens(F.col("text")).alias("w")).filter(F.size("w") > 0)
    return w.select("doc_id", (F.size(F.array_distinct("w")) / F.size("w")).alias("ttr"), F.size("w").cast("bigint").alias("n"))


@query(
    f"""WITH w AS (SELECT doc_id, {toks('text')} AS w FROM documents), g AS (SELECT doc_id, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g FROM w)
    SELECT doc_id, CASE WHEN len(g) = 0 THEN 0.0 ELSE round(CAST(len(list_distinct(g)) AS DOUBLE) / len(g), 9) END AS distinct_3,
      CASE WHEN len(g) = 0 THEN 0.0 ELSE round(1 - CAST(len(list_distinct(g)) AS DOUBLE) / len(g), 9) END AS repetition FROM g"""
)
def ngram_repetition(spark, d):
    out = evaluate.narrative(table(spark, d, "documents").select("doc_id", "text"), "text")
    return out.select("doc_id", F.round("distinct_3", 9).alias("distinct_3"), F.round("trigram_repetition", 9).alias("repetition"))


@query(
    f"""WITH s AS (SELECT doc_id, len({sents('text')}) AS n_s, {toks('text')} AS w FROM documents),
    y AS (SELECT doc_id, n_s, len(w) AS n_w, list_sum(list_transform(w, lambda x: CASE WHEN regexp_replace(x, '[^a-z]', '', 'g') = '' THEN 0
      ELSE greatest(1, len(regexp_extract_all(regexp_replace(x, '[^a-z]', '', 'g'), '[aeiouy]+')) - CASE WHEN regexp_replace(x, '[^a-z]', '', 'g') LIKE '%e' AND len(regexp_extract_all(regexp_replace(x, '[^a-z]', '', 'g'), '[aeiouy]+')) > 1 THEN 1 ELSE 0 END) END)) AS syl FROM s)
    SELECT doc_id, CAST(coalesce(syl, 0) AS BIGINT) AS syllables, CASE WHEN n_s = 0 OR n_w = 0 THEN 0.0 ELSE round(206.835 - 1.015 * (CAST(n_w AS DOUBLE) / n_s) - 84.6 * (CAST(syl AS DOUBLE) / n_w), 6) END AS flesch FROM y"""
)
def readability(spark, d):
    r = table(spark, d, "documents").select("doc_id", F.size(X.sentences(F.col("text"))).alias("n_s"), X.tokens(F.col("text")).alias("w"))
    r = r.withColumn("syl", F.aggregate("w", F.lit(0), lambda a, x: a + X.syllables(x)))
    return r.select("doc_id", F.col("syl").cast("bigint").alias("syllables"), F.round(X.flesch(F.col("n_s"), F.size("w"), F.col("syl")), 6).alias("flesch"))


@query()
def narrative_metrics(spark, d):
    return evaluate.narrative(table(spark, d, "documents").select("doc_id", "text"), "text").drop("text")


def _sentence_rows(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "text"))


@query(
    f"""WITH s AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS text FROM (SELECT doc_id, {sents('text')} AS s FROM documents)), t AS (SELECT *, list_distinct({toks('text')}) AS w FROM s),
    p AS (SELECT doc_id, w, lag(w) OVER (PARTITION BY doc_id ORDER BY pos) AS q FROM t)
    SELECT doc_id, round(avg(CASE WHEN len(list_distinct(list_concat(w, q))) = 0 THEN 1.0 ELSE CAST(len(list_intersect(w, q)) AS DOUBLE) / len(list_distinct(list_concat(w, q))) END), 9) AS overlap FROM p WHERE q IS NOT NULL GROUP BY 1"""
)
def adjacent_overlap(spark, d):
    w = Window.partitionBy("doc_id").orderBy("pos")
    t = _sentence_rows(spark, d).withColumn("w", F.array_distinct(X.tokens(F.col("text")))).withColumn("q", F.lag("w").over(w)).filter("q is not null")
    return t.groupBy("doc_id").agg(F.round(F.avg(X.jaccard(F.col("w"), F.col("q"), 1.0)), 9).alias("overlap"))


@query(
    f"""WITH s AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS text FROM (SELECT doc_id, {sents('text')} AS s FROM documents)),
    g AS (SELECT doc_id, pos, list_distinct(list_transform(range(1, greatest(length(t) - 1, 1)), lambda i: substr(t, i, 3))) AS g FROM (SELECT doc_id, pos, lower(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS t FROM s)),
    l AS (SELECT doc_id, pos, g, lag(g) OVER (PARTITION BY doc_id ORDER BY pos) AS h FROM g),
    n AS (SELECT doc_id, pos, CASE WHEN h IS NULL THEN 1 WHEN (CASE WHEN len(list_distinct(list_concat(g, h))) = 0 THEN 1.0 ELSE CAST(len(list_intersect(g, h)) AS DOUBLE) / len(list_distinct(list_concat(g, h))) END) < 0.8 THEN 1 ELSE 0 END AS nw FROM l),
    r AS (SELECT doc_id, sum(nw) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM n)
    SELECT doc_id, max(c) AS streak FROM (SELECT doc_id, run, count(*) AS c FROM r GROUP BY 1, 2) GROUP BY 1"""
)
def repeat_streak(spark, d):
    return evaluate.repeat_streak(table(spark, d, "documents"), "doc_id", "text", 0.8)


# --- support and coverage ---


def _talk(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.explode(X.sentences(F.col("text"))).alias("text")).filter(F.char_length("text") > 0)
    lines = c.groupBy("conv_id", "role", "text").agg(F.min("turn").alias("turn"))
    rank = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn", "text")).cast("bigint")
    lines = lines.withColumn("pos", rank)
    return lines.filter("role = 'assistant'").select("conv_id", "pos", "text"), lines.filter("role = 'user'").select("conv_id", "pos", "text")


_CLEAN = r"trim(regexp_replace(regexp_replace(translate({t}, '“”’', '\"\"'''), 'https?://[^ \t\n\r\f\v]+|<[^>]+>', '', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'))".replace('\\"', '"')
_PAIRS = f"""raw AS (SELECT conv_id, turn, role, unnest({sents('text')}) AS text FROM conversations), ln AS (SELECT conv_id, role, text, min(turn) AS turn FROM raw GROUP BY 1, 2, 3),
  f AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS pos, regexp_extract_all(lower({_CLEAN.format(t='text')}), '[a-z0-9'']+') AS tok,
    ' ' || lower(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')) || ' ' AS pad, list_distinct(regexp_extract_all(plain, '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+){{0,3}})\\b')) AS names,
    list_distinct(regexp_extract_all(plain, '\\b\\d[\\d,\\.]*\\b')) AS nums, list_distinct(regexp_extract_all(plain, '\\b(19|20)\\d{{2}}\\b')) AS years FROM (SELECT *, regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g') AS plain FROM ln)),
  g AS (SELECT *, list_distinct(list_transform(range(1, greatest(length(pad) - 1, 1)), lambda i: substr(pad, i, 3))) AS gram FROM f),
  p AS (SELECT q.conv_id, q.pos AS q_pos, q.text AS q_text, c.pos AS c_pos, q.tok AS a, c.tok AS b, q.gram AS ga, c.gram AS gb,
    CASE WHEN len(list_intersect(q.names, c.names)) > 0 THEN 1.0 ELSE 0.0 END AS names, CASE WHEN len(list_intersect(q.nums, c.nums)) > 0 THEN 1.0 ELSE 0.0 END AS nums,
    CASE WHEN len(list_intersect(q.years, c.years)) > 0 THEN 1.0 ELSE 0.0 END AS years FROM g q JOIN g c ON q.conv_id = c.conv_id AND q.role = '{{q}}' AND c.role = '{{c}}'),
  v AS (SELECT *, list_distinct(list_concat(a, b)) AS vocab FROM p),
  x AS (SELECT *, list_transform(vocab, lambda t: len(list_filter(a, lambda y: y = t)) * (CASE WHEN list_contains(a, t) AND list_contains(b, t) THEN 1.0 ELSE ln(1.5) + 1 END)) AS xa,
    list_transform(vocab, lambda t: len(list_filter(b, lambda y: y = t)) * (CASE WHEN list_contains(a, t) AND list_contains(b, t) THEN 1.0 ELSE ln(1.5) + 1 END)) AS xb FROM v),
  s AS (SELECT conv_id, q_pos, q_text, c_pos, names, nums, years, CASE WHEN len(vocab) = 0 THEN 0.0 ELSE list_sum(list_transform(range(1, len(vocab) + 1), lambda i: xa[i] * xb[i]))
      / ((sqrt(list_sum(list_transform(xa, lambda z: z * z))) + 1e-9) * (sqrt(list_sum(list_transform(xb, lambda z: z * z))) + 1e-9)) END AS tfidf,
    CASE WHEN len(ga) = 0 OR len(gb) = 0 THEN 0.0 ELSE CAST(len(list_intersect(ga, gb)) AS DOUBLE) / len(list_distinct(list_concat(ga, gb))) END AS char3 FROM x),
  m AS (SELECT *, round(greatest(tfidf, char3) + 0.06 * names + 0.04 * greatest(nums, years), 9) AS signal FROM s),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, q_pos ORDER BY signal DESC, c_pos) AS r FROM m) WHERE r = 1
    UNION ALL SELECT conv_id, pos, text, -1, 0, 0, 0, 0, 0, -1, 1 FROM g WHERE role = '{{q}}' AND conv_id NOT IN (SELECT conv_id FROM g WHERE role = '{{c}}'))"""


def _pairs_sql(q: str, c: str) -> str:
    return "WITH " + _PAIRS.replace("{q}", q).replace("{c}", c)


_SUPPORTED = "(names >= 1 AND (nums >= 1 OR years >= 1) OR tfidf >= 0.35 OR char3 >= 0.28)"


@query(_pairs_sql("assistant", "user") + " SELECT conv_id, q_pos AS pos, CAST(c_pos AS BIGINT) AS best_pos, round(tfidf, 6) AS tfidf, round(char3, 6) AS char3 FROM best")
def support_pairs(spark, d):
    said, heard = _talk(spark, d)
    return evaluate.best_match(said, heard, "conv_id").select("conv_id", "pos", "best_pos", F.round("tfidf", 6).alias("tfidf"), F.round("char3", 6).alias("char3"))


@query(_pairs_sql("assistant", "user") + f" SELECT conv_id, count(DISTINCT q_text) AS n, CAST(sum(CAST({_SUPPORTED} AS INT)) AS BIGINT) AS supported, round(100 * avg(CAST({_SUPPORTED} AS INT)), 6) AS pct FROM best GROUP BY 1")
def support_summary(spark, d):
    said, heard = _talk(spark, d)
    return evaluate.summary(evaluate.decide(evaluate.best_match(said, heard, "conv_id")), "conv_id")


@query(_pairs_sql("user", "assistant") + f" SELECT conv_id, count(DISTINCT q_text) AS n, CAST(sum(CAST({_SUPPORTED} AS INT)) AS BIGINT) AS supported, round(100 * avg(CAST({_SUPPORTED} AS INT)), 6) AS pct FROM best GROUP BY 1")
def coverage_summary(spark, d):
    said, heard = _talk(spark, d)
    return evaluate.summary(evaluate.decide(evaluate.best_match(heard, said, "conv_id")), "conv_id")


@query(
    _pairs_sql("assistant", "user")
    + " SELECT conv_id, q_pos AS pos, (names >= 1 AND (nums >= 1 OR years >= 1) OR (tfidf >= 0.35 AND char3 >= 0.28)) AS supported, 'vote(' || (CAST(tfidf >= 0.35 AS INT) + CAST(char3 >= 0.28 AS INT)) || '/2)' AS votes FROM best"
)
def decision_vote(spark, d):
    said, heard = _talk(spark, d)
    s = evaluate.Settings(decision="vote")
    out = evaluate.decide(evaluate.best_match(said, heard, "conv_id", s), s)
    return out.select("conv_id", "pos", "supported", F.regexp_extract("rule", r"vote\(\d/\d\)", 0).alias("votes")).withColumn("votes", F.when(F.col("votes") == "", "vote(0/2)").otherwise(F.col("votes")))


@query(_pairs_sql("assistant", "user") + f" SELECT conv_id, q_pos AS pos, round(greatest(tfidf, char3), 6) AS l FROM best WHERE NOT {_SUPPORTED} AND greatest(tfidf, char3) >= 0.2 AND greatest(tfidf, char3) < 0.35 ORDER BY greatest(tfidf, char3) DESC, conv_id, q_pos LIMIT 50")
def near_miss_topk(spark, d):
    said, heard = _talk(spark, d)
    matched = evaluate.to_the_last_digit(evaluate.best_match(said, heard, "conv_id"), 0.2, 0.35, 50)
    out = evaluate.near_misses(evaluate.decide(matched), 0.2, 0.35, 50)
    return out.select("conv_id", "pos", F.round("L", 6).alias("l"))


@query()
def support_rrf(spark, d):
    said, heard = _talk(spark, d)
    return evaluate.best_match(said, heard, "conv_id", evaluate.Settings(fusion="rrf")).select("conv_id", "pos", "best_pos", "signal")


# --- retrieval ---

_Q = "SELECT vec_id AS q, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 100 = 0"


@query(
    f"""WITH q AS ({_Q}), s AS (SELECT q.q AS query_id, e.vec_id AS id, round(list_cosine_similarity(q.v, CAST(e.embedding AS DOUBLE[])), 9) AS score FROM q JOIN embeddings e ON e.vec_id <> q.q)
    SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10"""
)
def knn_cosine_topk(spark, d):
    e = table(spark, d, "embeddings")
    return retrieve.nearest(e, e.filter("vec_id % 100 = 0"), 10).withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    f"""WITH q AS ({_Q}), s AS (SELECT q.q AS query_id, e.vec_id AS id, round(list_cosine_similarity(q.v, CAST(e.embedding AS DOUBLE[])), 9) AS score FROM q JOIN embeddings e ON e.vec_id <> q.q)
    SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10"""
)
def knn_ivf_all_cells(spark, d):
    e = table(spark, d, "embeddings")
    index = vectors.build(e, scratch(spark))
    found = vectors.search(index, e.filter("vec_id % 100 = 0"), 10, index.cells)
    return found.withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    f"""WITH q AS ({_Q}), s AS (SELECT q.q AS query_id, e.vec_id AS id, round(list_inner_product(q.v, CAST(e.embedding AS DOUBLE[])), 9) AS score FROM q JOIN embeddings e ON e.vec_id <> q.q)
    SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10"""
)
def knn_ip_topk(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.nearest(e, e.filter("vec_id % 100 = 0"), 10, "ip").withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("bigint"))


@query()
def knn_ivf_recall(spark, d):
    """Per query: how many of its 10 exact neighbours the index finds with the probes it was measured to need."""
    e = table(spark, d, "embeddings")
    asked = e.filter("vec_id % 100 = 0")
    index = vectors.build(e, scratch(spark))
    found = vectors.search(index, asked, 10, vectors.probes_for(index, spark, 10))
    return vectors.recall_of(found, vectors.nearest(e, asked, 10))


@query(
    f"""WITH q AS ({_Q}), s AS (SELECT q.q AS query_id, e.vec_id AS id, e.label, round(list_distance(q.v, CAST(e.embedding AS DOUBLE[])), 9) AS score FROM q JOIN embeddings e ON e.vec_id <> q.q),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank FROM s) WHERE rank <= 50)
    SELECT query_id, id, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM f WHERE label = 1) WHERE place <= 5"""
)
def knn_l2_postfilter(spark, d):
    e = table(spark, d, "embeddings")
    found = retrieve.nearest(e, e.filter("vec_id % 100 = 0"), 50, "l2")
    out = retrieve.post_filtered(found, e.select(F.col("vec_id").alias("id"), "label"), F.col("label") == 1, 5)
    return out.select("query_id", "id", F.col("place").cast("bigint").alias("place"))


_CLOSE = """v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    p AS (SELECT b.id, a.id AS near, round(list_cosine_similarity(a.v, b.v), 9) AS cosine FROM v a JOIN v b ON a.id < b.id AND round(list_cosine_similarity(a.v, b.v), 9) >= 0.4)"""


@query(f"WITH {_CLOSE} SELECT id, near, round(cosine, 6) AS cosine FROM p WHERE near IN (SELECT min(id) FROM v GROUP BY v) AND id IN (SELECT min(id) FROM v GROUP BY v)")
def similar_pairs(spark, d):
    return leaders.similar_pairs(table(spark, d, "embeddings"), 0.4).withColumn("cosine", F.round("cosine", 6))


@query(
    f"""WITH RECURSIVE {_CLOSE}, n AS (SELECT id, list(near) AS near FROM p GROUP BY id), r AS (SELECT id, near, row_number() OVER (ORDER BY id) AS r FROM v LEFT JOIN n USING (id)),
    g AS (SELECT CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS led UNION ALL SELECT r.r, CASE WHEN len(list_intersect(r.near, led)) > 0 THEN led ELSE list_append(led, r.id) END FROM g JOIN r ON r.r = g.r + 1)
    SELECT id, coalesce(list_min(list_intersect(near, (SELECT led FROM g ORDER BY r DESC LIMIT 1))), id) AS leader FROM r"""
)
def question_dedupe(spark, d):
    return leaders.leaders(table(spark, d, "embeddings"), 0.4)


_BM25 = f"""d AS (SELECT doc_id, {toks('text')} AS w FROM documents), l AS (SELECT doc_id, greatest(len(w), 1) AS len FROM d), a AS (SELECT count(*) AS n, avg(len) AS mean FROM l),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  q AS (SELECT item_id AS query_id, unnest(list_distinct({toks('text')})) AS term FROM benchmark), i AS (SELECT term, greatest(0, ln((n - df + 0.5) / (df + 0.5) + 1e-9)) AS idf FROM df, a),
  s AS (SELECT query_id, tf.doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.5 + 0.5 * len / mean))), 9) AS score FROM q JOIN i USING (term) JOIN tf USING (term) JOIN l ON l.doc_id = tf.doc_id, a WHERE idf > 0 GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)"""


def _bm25(spark, d, k):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieve.bm25(items, table(spark, d, "documents").select("doc_id", "text"), k)


@query(f"WITH {_BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def bm25_topk(spark, d):
    return _bm25(spark, d, 10).withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    f"""WITH {_BM25}, o AS (SELECT query_id, doc_id, rank FROM r WHERE rank <= 20), z AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM o)
    SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM o UNION ALL SELECT * FROM z) GROUP BY 1, 2"""
)
def rrf_fusion(spark, d):
    one = cut(_bm25(spark, d, 20).select("query_id", "doc_id", "rank"))
    two = one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")))
    return retrieve.rrf([one, two], ["query_id", "doc_id"])


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'licensed') OR contains(lower(source), 'licensed') OR contains(lower(text), 'worthless') OR contains(lower(source), 'worthless')")
def like_fallback(spark, d):
    return retrieve.keyword_fallback(table(spark, d, "documents"), ["licensed", "Worthless"], ["text", "source"]).select("doc_id")


@query("SELECT conv_id, count(*) AS n, count(DISTINCT role) AS roles FROM conversations GROUP BY 1")
def beat_fanout(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list("role").alias("roles"))
    return retrieve.fan_out(c, "roles", "role").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_distinct("role").alias("roles"))


@query("SELECT DISTINCT conv_id FROM conversations WHERE role = 'user' AND conv_id IN (SELECT conv_id FROM conversations WHERE role = 'assistant')")
def plan_intersect(spark, d):
    c = table(spark, d, "conversations")
    return c.filter("role = 'user'").select("conv_id").distinct().join(c.filter("role = 'assistant'"), "conv_id", "left_semi")


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def keep_first_dedupe(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha2(F.lower(F.trim("text")), 256).alias("key"))
    return retrieve.keep_first(docs, F.col("key"), [F.col("doc_id")]).select("doc_id", "source")


@query()
def sample_unique(spark, d):
    return retrieve.sample_per_group(table(spark, d, "documents").select("lang", "doc_id"), "lang", "doc_id", 20, 7)


# --- web ---


@query(r"SELECT page_id, url, regexp_extract(url, '#(.*)$', 1) AS fragment, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9_+.-]*://([^/?#:@]*)', 1)) AS host FROM pages")
def url_parts(spark, d):
    return table(spark, d, "pages").select("page_id", "url", web.url_fragment(F.col("url")).alias("fragment"), web.url_host(F.col("url")).alias("host"))


@query(
    r"""SELECT page_id FROM (SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9_+.-]*://([^/?#:@]*)', 1)) AS h FROM pages)
    WHERE (h = 'example.com' OR suffix(h, '.example.com') OR h = 'example.org' OR suffix(h, '.example.org')) AND NOT (h = 'casino-win.example.com' OR suffix(h, '.casino-win.example.com')) AND NOT prefix(url, 'http://m.')"""
)
def url_domain_filter(spark, d):
    return table(spark, d, "pages").filter(web.keep_url(F.col("url"), ["example.com", "example.org"], ["casino-win.example.com"], ["http://m."])).select("page_id")


_SP = r"[ \t\n\r\f\v]+"


@query(rf"SELECT page_id, nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '{_SP}', ' ', 'g')), '') AS title FROM pages")
def html_title(spark, d):
    return table(spark, d, "pages").select("page_id", web.html_title(F.col("html")).alias("title"))


_TEXT = rf"trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace({{h}}, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '{_SP}', ' ', 'g'))"


@query(f"SELECT page_id, sha256({_TEXT.format(h='html')}) AS text_sha256, CAST(length({_TEXT.format(h='html')}) AS BIGINT) AS n FROM pages")
def html_text(spark, d):
    t = table(spark, d, "pages").select("page_id", web.html_text(F.col("html")).alias("t"))
    return t.select("page_id", F.sha2("t", 256).alias("text_sha256"), F.char_length("t").cast("bigint").alias("n"))


@query("""SELECT page_id, array_to_string(regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1), ' ') AS links FROM pages""")
def html_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(web.html_links(F.col("html")), " ").alias("links"))


@query()
def html_sections(spark, d):
    s = table(spark, d, "pages").select("page_id", F.explode(web.html_sections(F.col("html"))).alias("s"))
    return s.select("page_id", "s.level", "s.title", F.char_length("s.text").alias("n"))


@query(
    """SELECT doc_id, CAST(i AS INT) AS pos, substr(text, i * 400 + 1, 500) AS chunk FROM (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 500 THEN 1 ELSE 1 + CAST(ceil((length(text) - 500) / 400.0) AS INT) END)) AS i FROM documents)"""
)
def chunk_fixed(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(X.fixed_chunks(F.col("text"), 500, 100)).alias("pos", "chunk"))


@query(
    """SELECT source, doc_id, pos FROM (SELECT source, doc_id, pos, row_number() OVER (PARTITION BY source ORDER BY doc_id, pos) AS r FROM
    (SELECT source, doc_id, CAST(unnest(range(0, CASE WHEN length(text) <= 500 THEN 1 ELSE 1 + CAST(ceil((length(text) - 500) / 500.0) AS INT) END)) AS INT) AS pos FROM documents)) WHERE r <= 30"""
)
def chunk_total_cap(spark, d):
    chunks = table(spark, d, "documents").select("source", "doc_id", F.posexplode(X.fixed_chunks(F.col("text"), 500)).alias("pos", "chunk"))
    return retrieve.capped(chunks.drop("chunk"), "source", [F.col("doc_id"), F.col("pos")], 30)


@query(
    f"""WITH s AS (SELECT doc_id, generate_subscripts(s, 1) AS i, unnest(s) AS x FROM (SELECT doc_id, {sents('text')} AS s FROM documents)), w AS (SELECT *, len(string_split_regex(trim(x, chr(32)), '{_SP}')) AS n FROM s),
    c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS cum FROM w), k AS (SELECT *, (cum - n < 60 AND cum <= 90) AS ok FROM c), m AS (SELECT *, min(CASE WHEN ok THEN NULL ELSE i END) OVER (PARTITION BY doc_id) AS stop FROM k)
    SELECT d.doc_id, coalesce(t.summary, '') AS summary FROM documents d LEFT JOIN (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS summary FROM m WHERE stop IS NULL OR i < stop GROUP BY 1) t USING (doc_id)"""
)
def summary_extractive(spark, d):
    s = table(spark, d, "documents").select("doc_id", X.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", web.extractive_summary(F.col("s"), 60, 90).alias("summary"))


# --- scores ---


@query("SELECT source, doc_id, CASE WHEN hi > lo THEN round(100 * (n_chars - lo) / CAST(hi - lo AS DOUBLE), 6) ELSE 50.0 END AS nqi FROM (SELECT source, doc_id, n_chars, min(n_chars) OVER (PARTITION BY source) AS lo, max(n_chars) OVER (PARTITION BY source) AS hi FROM documents)")
def minmax_nqi(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return evaluate.min_max(docs, {"n_chars": True}, ["source"]).select("source", "doc_id", F.round("nqi", 6).alias("nqi"))


@query(
    """SELECT lang, count(*) AS n, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS std, CAST(min(n_chars) AS DOUBLE) AS min, quantile_cont(n_chars, 0.25) AS p25, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.75) AS p75, CAST(max(n_chars) AS DOUBLE) AS max FROM documents GROUP BY 1"""
)
def metric_stats(spark, d):
    out = evaluate.metric_stats(table(spark, d, "documents").withColumn("x", F.col("n_chars").cast("double")), ["lang"], "x")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query()
def spelled_numbers(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", sequential.normalise_spelled_numbers("text").alias("text"))


@query()
def near_lines(spark, d):
    lines = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("lines"))
    return lines.select("conv_id", F.size("lines").alias("n"), F.size(sequential.drop_near_lines("lines", 0.85)).alias("kept"))


# --- JSON at any depth ---


def _talks(spark, d):
    """Every conversation as one nested JSON text."""
    turn = F.struct("turn", "role", F.struct("text", F.length("text").alias("chars"), (F.length("text") > 200).alias("long")).alias("said"))
    talks = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return talks.select("conv_id", F.to_json(F.struct("turns")).alias("json"))


@query(
    """WITH c AS (SELECT conv_id AS key, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, turn, text FROM conversations)
    SELECT key, 'turns[' || i || '].turn' AS path, CAST(turn AS DOUBLE) AS value FROM c WHERE turn IS NOT NULL UNION ALL SELECT key, 'turns[' || i || '].said.chars', length(text) FROM c WHERE text IS NOT NULL
    UNION ALL SELECT key, 'turns[' || i || '].said.long', CAST(length(text) > 200 AS INT) FROM c WHERE text IS NOT NULL
    UNION ALL SELECT event_id, 'k', CAST(props ->> 'k' AS DOUBLE) FROM events WHERE props ->> 'k' IS NOT NULL"""
)
def json_numbers(spark, d):
    events = table(spark, d, "events").select("event_id", "props")
    return variants.flat_numbers(_talks(spark, d), "conv_id", "json").unionByName(variants.flat_numbers(events, "event_id", "props"))


@query(
    """WITH s AS (SELECT conv_id AS key, unnest([role, text]) AS t FROM conversations), e AS (SELECT key, trim(regexp_replace(t, '[ \t\n\r\f\v]+', ' ', 'g'), ' ') AS text FROM s)
    SELECT DISTINCT key, text FROM e WHERE text <> ''"""
)
def json_texts(spark, d):
    return variants.texts(_talks(spark, d), "conv_id", "json").select("key", "text")


@query()
def keyword_search(spark, d):
    """The ten best documents of every test item by stems; the tests hold it against scoring everything."""
    index = search.build(table(spark, d, "documents").select("doc_id", "text"), scratch(spark))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.search(index, items, 10)[0]
