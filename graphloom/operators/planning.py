"""Question indexes, plans and evidence: validation, manifests, picks, references, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import sentences


def index_report(index: DataFrame, fields: list[str]) -> DataFrame:
    """One row: questions, those with a query, those missing each field."""
    empty = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))
    counts = [F.sum(empty(c).cast("long")).alias(f"missing_{c}") for c in fields]
    return index.agg(F.count("*").alias("total"), *counts)


def manifest(index: DataFrame, source: str, query: str, width: int = 200) -> DataFrame:
    """Per source: queries, their mean length, and the first line of the shortest."""
    line = F.substring(F.substring_index(F.trim(query), "\n", 1), 1, width)
    rows = index.filter(F.col(query).isNotNull()).withColumns({"__n": F.char_length(query), "__line": line})
    return rows.groupBy(source).agg(F.count("*").alias("n"), F.round(F.avg("__n"), 6).alias("mean_length"), F.min_by("__line", F.struct("__n", "__line")).alias("preview"))


def mode_matches(modes: Column, mode: str, missing_means_all: bool = False) -> Column:
    """Whether a list of modes has one, case ignored."""
    hit = F.array_contains(F.transform(modes, lambda m: F.lower(F.trim(m))), mode.lower())
    return F.coalesce(hit, F.lit(missing_means_all)) if not missing_means_all else F.coalesce(hit | (F.size(modes) == 0), F.lit(True))


def common_titles(rows: DataFrame, title: str, k: int) -> DataFrame:
    """The most frequent titles, first by name of equals."""
    return rows.groupBy(title).agg(F.count("*").alias("n")).orderBy(F.desc("n"), title).limit(k)


def embedding_text(question: Column, answer: Column | None = None, beats: Column | None = None) -> Column:
    """What is embedded of a question: itself, with its answer and beats where given."""
    parts = [question, *([answer] if answer is not None else []), *([F.array_join(beats, "; ")] if beats is not None else [])]
    return F.trim(F.concat_ws("\n", *(F.nullif(F.trim(p), F.lit("")) for p in parts)))


def evidence_ok(rows: Column, has_query: Column, required: bool = False) -> Column:
    """Whether an item counts as answered: rows were found, or it asks for none."""
    return (rows > 0) | (~has_query & F.lit(not required))


def references(kg: DataFrame, web: DataFrame, cq: str, key: str) -> DataFrame:
    """Numbered references per question: graph rows first, then web pages not yet named."""
    both = kg.select(cq, key, F.lit(0).alias("kind")).unionByName(web.select(cq, key, F.lit(1).alias("kind")))
    first = both.groupBy(cq, key).agg(F.min("kind").alias("kind"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy(cq).orderBy("kind", key)))


def facts_trace(texts: DataFrame, values: DataFrame, group: str) -> DataFrame:
    """(group, pos, sentence, value): which of a group's values each of its sentences holds."""
    s = texts.select(group, F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))
    v = values.select(group, F.col("value")).filter("value <> ''").distinct()
    return s.join(v, group).filter(F.contains(F.lower("sentence"), F.lower("value")))


def unmatched(texts: DataFrame, trace: DataFrame, group: str) -> DataFrame:
    """Sentences that hold no value."""
    s = texts.select(group, F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))
    return s.join(trace.select(group, "pos").distinct(), [group, "pos"], "left_anti")


def set_coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of either side with the side that misses them."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("missing_in", F.lit("right")).unionByName(b.join(a, key, "left_anti").withColumn("missing_in", F.lit("left")))
