"""A corpus pipeline over ``documents``: each stage is one operator's decision, applied.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns the rows it keeps. ``run`` applies them in order, each stage's rows
written to the shared folder and read back, so a lost executor never reaches
further back than one stage.

Defined results: null texts are empty ones; empty and wordless texts are alike, so
one of them at most stays after near-dedup. Rows without an id sort after all
others and are never taken for labelled rows. Of rows that repeat, the first
stays. Columns beyond those of documents are kept by all stages but the last,
whatever their names. Without labels of both kinds the first stage keeps all
rows; without test items the fourth does. Empty documents give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontaminate, packing, quality, simhash, suffix_dedup
from graphloom.llm.common import cut, release, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.keep_one(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of repeated passages go; so do documents of which nothing is left."""
    return suffix_dedup.drop_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test window go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_filter),
    ("simhash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: Learned scores, fingerprints and token packing have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept: list[DataFrame] = []
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        kept.append(docs)
    release(*kept[:-1])
    return docs
