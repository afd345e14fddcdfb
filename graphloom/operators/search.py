"""Ranked keyword search over a stored index of stems, in order of impact.

A posting is a document's saturated term frequency (BM25 without the weight of
the term). The postings of a term are kept in bands of impact, a band in parts of
bounded size dealt by document, so that no task sorts or holds the list of a
frequent term; ``heads`` tell how many documents a band has and its largest
impact. ``forward`` keeps the same postings by document.

A search reads the bands of its terms from the top, for all queries at once, half
as far down each round, until no unread document can reach the best k that were
found; the rest of their lists is skipped. Candidates that could be among the best
are then scored exactly from ``forward``. The result equals scoring everything.

The mean length is the one at the time of ``build``; counts of documents follow
``upsert``. Null texts are empty; documents without a known word are never found,
queries without one find nothing. Of rows that share an id the longest text counts.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.stem import stems
from graphloom.functions.text import tokens
from graphloom.operators.lineage import cut

K1, B = 1.2, 0.75
#: Impacts lie below K1 + 1; a band is one part of this many.
BANDS = 32
#: Documents of one part of a band, on average; buckets of documents in ``forward``.
PART, BUCKETS = 4096, 64
#: Rounds that each read half as far down; the one after reads everything.
ROUNDS = 6
TABLES = {
    "heads": "term string, band int, n long, best double, parts int",
    "blocks": "term string, band int, part int, postings array<struct<doc_id: bigint, w: double>>",
    "forward": "doc_id long, term string, w double, bucket int",
}


class Index:
    """Tables below ``path``: heads, blocks, forward; ``n`` documents, ``mean`` words a document at the time of ``build``."""

    def __init__(self, path: str, n: int, mean: float):
        self.path, self.n, self.mean = path, n, mean

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}")


def _weights(docs: DataFrame, mean: float | None) -> tuple[DataFrame, int, float]:
    """(doc_id, term, w) of all documents, how many there are, and their mean length."""
    once = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").groupBy("doc_id").agg(F.max_by(F.coalesce("text", F.lit("")), F.struct(F.length("text"), F.col("text"))).alias("text"))
    words = once.select("doc_id", stems(tokens(F.col("text"))).alias("terms")).withColumn("len", F.size("terms"))
    # only counted terms are written; a document's first term (or none) stands for it
    places = words.select("doc_id", "len", F.posexplode_outer("terms").alias("pos", "term"))
    counted = cut(places.groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"), F.coalesce(F.min("pos"), F.lit(0)).alias("pos")))
    n, average = counted.filter("pos = 0").agg(F.count("*"), F.avg("len")).first()
    mean = mean or float(average or 1) or 1.0
    tf = counted.filter("term is not null")
    w = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean))
    return tf.select("doc_id", "term", F.round(w, 9).alias("w")), n, mean


def _blocked(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, band, part, docs, ws) and (term, band, n, parts, best)."""
    banded = postings.withColumn("band", F.least(F.floor(F.col("w") * BANDS / (K1 + 1)).cast("int"), F.lit(BANDS - 1)))
    heads = cut(banded.groupBy("term", "band").agg(F.count("*").alias("n"), F.max("w").alias("best")).withColumn("parts", F.ceil(F.col("n") / PART).cast("int")))
    many = cut(heads.filter("parts > 1").select("term", "band", "parts"))  # few: a row for every PART postings at most
    dealt = banded.join(many, ["term", "band"], "left").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1))).cast("int"))
    blocks = dealt.groupBy("term", "band", "part").agg(F.collect_list(F.struct("doc_id", "w")).alias("postings"))
    return blocks, heads


def _write(index: Index, postings: DataFrame, blocks: DataFrame, heads: DataFrame) -> Index:
    spark = postings.sparkSession
    # as they were grouped: a file holds its terms in order
    blocks.sortWithinPartitions("term", "band").write.parquet(f"{index.path}/blocks")
    heads.write.parquet(f"{index.path}/heads")
    postings.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")).repartition("bucket").sortWithinPartitions("doc_id").write.partitionBy("bucket").parquet(f"{index.path}/forward")
    spark.createDataFrame([(json.dumps({"n": index.n, "mean": index.mean}),)], "value string").coalesce(1).write.text(f"{index.path}/about")
    return index


def build(docs: DataFrame, path: str) -> Index:
    """Index ``docs`` (doc_id, text) below a new path."""
    postings, n, mean = _weights(docs, None)
    return _write(Index(path, n, mean), postings, *_blocked(postings))


def load(spark: SparkSession, path: str) -> Index:
    about = json.loads(spark.read.text(f"{path}/about").first().value)
    return Index(path, about["n"], about["mean"])


def upsert(index: Index, docs: DataFrame, path: str) -> Index:
    """A new index below ``path`` in which ``docs`` replace those of the same ids; only bands that change are made anew."""
    spark = docs.sparkSession
    new, _, _ = _weights(docs, index.mean)
    new = cut(new)
    ids = cut(docs.select("doc_id").filter("doc_id is not null").distinct())
    old = index.table(spark, "forward").drop("bucket")
    known = old.join(ids, "doc_id", "left_semi").select("doc_id").distinct()
    band = F.least(F.floor(F.col("w") * BANDS / (K1 + 1)).cast("int"), F.lit(BANDS - 1)).alias("band")
    touched = cut(old.join(ids, "doc_id", "left_semi").select("term", band).unionByName(new.select("term", band)).distinct())
    postings = cut(old.join(ids, "doc_id", "left_anti").unionByName(new))
    again = postings.withColumn("band", band).join(touched, ["term", "band"], "left_semi").drop("band")
    blocks, heads = _blocked(again)
    kept = [index.table(spark, t).join(touched, ["term", "band"], "left_anti") for t in ("blocks", "heads")]
    n = index.n + ids.count() - known.count()
    return _write(Index(path, n, index.mean), postings, kept[0].unionByName(blocks), kept[1].unionByName(heads))


def _asked(index: Index, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, term, idf) of known terms, and (query_id, term, idf, band, n, parts, impact) of their bands."""
    spark = queries.sparkSession
    terms = queries.filter("query_id is not null").select("query_id", F.explode(stems(tokens(F.col("text")))).alias("term")).distinct()
    heads = index.table(spark, "heads").join(cut(terms).select("term").distinct(), "term", "left_semi")
    df = heads.groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log(1 + (F.lit(float(index.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = cut(terms.join(df, "term").select("query_id", "term", idf.alias("idf")))
    bands = cut(weighed.join(heads, "term").withColumn("impact", F.col("idf") * F.col("best")))
    return weighed, bands


def _best(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


def exhaustive(index: Index, queries: DataFrame, k: int, every: bool = False) -> DataFrame:
    """The best ``k`` of each query by scoring all postings of its terms."""
    weighed, _ = _asked(index, queries)
    size = weighed.groupBy("query_id").agg(F.count("*").alias("terms"))
    postings = index.table(queries.sparkSession, "forward").select("doc_id", "term", "w").join(weighed, "term")
    scored = postings.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("idf") * F.col("w")), 9).alias("score"), F.count("*").alias("has"))
    return _best(scored.join(size, "query_id").filter((F.col("has") == F.col("terms")) | F.lit(not every)), k)


def search(index: Index, queries: DataFrame, k: int, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """(query_id, doc_id, score, rank) of the best ``k``; and (query_id, parts, skipped): parts of its lists and how many were not read.

    ``every``: only documents that hold all known terms of the query.
    """
    spark = queries.sparkSession
    weighed, bands = _asked(index, queries)
    size = cut(weighed.groupBy("query_id").agg(F.count("*").alias("terms")))
    top = bands.groupBy("query_id").agg(F.max("impact").alias("top"))
    lists = cut(bands.join(top, "query_id").withColumn("turn", F.least(F.floor(-F.log2(F.col("impact") / F.col("top"))).cast("int"), F.lit(ROUNDS))))
    blocks = index.table(spark, "blocks")
    seen, open_, told = None, size.select("query_id"), None
    for turn in range(ROUNDS + 1):
        wanted = lists.join(open_, "query_id", "left_semi").filter(F.col("turn") == turn)
        read = blocks.join(wanted.select("query_id", "term", "band", "idf"), ["term", "band"]).select("query_id", "term", F.explode("postings").alias("x"), "idf")
        read = read.groupBy("query_id", F.col("x.doc_id").alias("doc_id")).agg(F.sum(F.col("idf") * F.col("x.w")).alias("score"), F.count("*").alias("has"))
        seen = cut(read if seen is None else seen.unionByName(read).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"), F.sum("has").alias("has")))
        # what a document could still gain: for each term its largest band that was not read
        rest = lists.filter(F.col("turn") > turn).groupBy("query_id", "term").agg(F.max("impact").alias("m")).groupBy("query_id").agg(F.sum("m").alias("more"))
        sure = seen.join(size, "query_id").filter((F.col("has") == F.col("terms")) | F.lit(not every))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
        edge = sure.withColumn("r", rank).filter(F.col("r") == k).select("query_id", F.col("score").alias("edge"))
        state = size.select("query_id").join(rest, "query_id", "left").join(edge, "query_id", "left")
        state = state.select("query_id", F.coalesce("more", F.lit(0.0)).alias("more"), F.coalesce("edge", F.lit(-1.0)).alias("edge"))
        ended = cut(state.join(open_, "query_id", "left_semi").filter((F.col("more") < F.col("edge") - 1e-9) | (F.col("more") == 0)).withColumn("last", F.lit(turn)))
        told = ended if told is None else told.unionByName(ended)
        open_ = cut(open_.join(ended, "query_id", "left_anti"))
        if open_.isEmpty():
            break
    told = cut(told)
    likely = seen.join(told, "query_id").filter(F.col("score") + F.col("more") >= F.col("edge") - 1e-9).select("query_id", "doc_id")
    likely = cut(likely.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")))
    postings = index.table(spark, "forward").join(likely, ["bucket", "doc_id"]).join(weighed, ["query_id", "term"])
    scored = postings.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("idf") * F.col("w")), 9).alias("score"), F.count("*").alias("has"))
    best = _best(scored.join(size, "query_id").filter((F.col("has") == F.col("terms")) | F.lit(not every)), k)
    parts = lists.join(told, "query_id").groupBy("query_id").agg(F.sum("parts").alias("parts"), F.sum(F.when(F.col("turn") > F.col("last"), F.col("parts")).otherwise(0)).alias("skipped"))
    return best, parts

