"""The queries of the training-data operators, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import alignment, decontaminate, filter_audit, fingerprints, html, packing, quality, simhash, substring_dedup, suffix_dedup, token_files, topk_join, urls
from graphloom.llm.common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_output(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.imatch(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_bytes(table(spark, sf_dir, "documents"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_join.exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_quality": op2_quality,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_html": op4_html,
    "op5_token_files": op5_token_files,
    "op6_simhash": op6_simhash,
    "op7_packing": op7_packing,
    "op8_imatch": op8_imatch,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_urls": op10_urls,
    "op11_filter_audit": op11_filter_audit,
    "op12_exact_topk": op12_exact_topk,
    "op13_alignment": op13_alignment,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = r"regexp_extract_all(text, '[^ \x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op1_decontaminate": f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents), i AS (SELECT item_id, coalesce({_WORDS}, []) AS w FROM benchmark),
iw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS k FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT doc_id, k, dw.n, item FROM dw JOIN iw USING (win)),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op3_substring_dedup": f"""
WITH d AS (SELECT doc_id, coalesce({_SPACED}, []) AS w FROM documents),
win AS (SELECT doc_id, k, md5(array_to_string(w[k:k + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS first FROM win GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS pos FROM win JOIN f USING (h) WHERE first < doc_id),
g AS (SELECT doc_id, list(pos) AS gone FROM gone GROUP BY 1),
x AS (SELECT d.doc_id, w, CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(gone, p)), lambda p: w[p]) END AS kept FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(kept) AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM x""",
    "op9_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, k, md5_number(substr(h, 2 * k + 1, 200)) AS m FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) / 2 AS BIGINT) - 99)) AS k FROM d WHERE length(h) >= 200)),
f AS (SELECT m, min((doc_id, k)) AS first FROM win GROUP BY 1 HAVING count(*) > 1),
late AS (SELECT doc_id, k FROM win JOIN f USING (m) WHERE first < (doc_id, k)),
run AS (SELECT doc_id, k, sum(fresh) OVER (PARTITION BY doc_id ORDER BY k) AS r FROM (SELECT doc_id, k, CASE WHEN k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) <= 100 THEN 0 ELSE 1 END AS fresh FROM late)),
span AS (SELECT doc_id, r, min(k) AS a, max(k) + 100 AS b FROM run GROUP BY 1, 2),
keep AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS since FROM span),
part AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(h, CAST(2 * since + 1 AS BIGINT), CAST(2 * (a - since) AS BIGINT)), '' ORDER BY a) AS head FROM keep JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE head || substr(h, CAST(2 * last + 1 AS BIGINT)) END)) AS kept_sha256 FROM d LEFT JOIN part USING (doc_id)""",
    "op11_filter_audit": r"""
WITH f AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, '[^ \x09-\x0D]+'), []) AS w FROM documents),
d AS (SELECT f.doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * len(t), regexp_matches(t, '[#$%&*|]'),
    coalesce(f.doc_id > min(f.doc_id) OVER (PARTITION BY t), false)] AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM f LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1) USING (doc_id)),
l AS (SELECT unnest(range(1, 6)) AS x),
o AS (SELECT row_number() OVER () AS o, [a.x, b.x, c.x, d.x, e.x] AS xs FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, xs, unnest(range(1, 6)) AS k FROM o),
e AS (SELECT part, o, xs, k, xs[k] AS x, fails, good, toxic, fails[xs[k]] AS failed, len(list_filter(xs[:k - 1], lambda y: fails[y])) > 0 AS gone FROM d, s),
g AS (SELECT part, o, xs, k, x, count(*) FILTER (NOT gone AND NOT failed) AS kept, count(*) FILTER (NOT gone AND failed) AS removed, count(*) FILTER (gone AND failed) AS redundant,
    count(*) FILTER (failed AND len(list_filter(fails, lambda y: y)) = 1) AS unique_fails, count(*) FILTER (NOT gone AND failed AND good) AS good_lost, count(*) FILTER (NOT gone AND failed AND toxic) AS toxic_lost
  FROM e GROUP BY ALL)
SELECT part, list_aggregate(list_transform(xs, lambda y: substr('ABCDE', y, 1)), 'string_agg', '') AS filter_order, CAST(k AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM g""",
    "op12_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
