"""Other sources and sinks: edge lists, tolerant JSON, question lists, url lists, a page cache, snapshots."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from graphloom.terms import TRIPLE_FIELDS


def read_edge_csv(spark: SparkSession, path: str) -> DataFrame:
    """Triples from a CSV of subject, predicate, object; an object that is no URL is a literal."""
    rows = spark.read.option("header", "true").csv(path).toDF("s", "p", "o")
    is_iri = F.col("o").rlike("^https?://")
    out = rows.dropna().withColumns({"s_kind": F.lit("iri"), "o_kind": F.when(is_iri, "iri").otherwise("lit"), "o_dt": F.lit(""), "o_lang": F.lit("")})
    return out.select(*TRIPLE_FIELDS).dropDuplicates()


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines, broken lines and lines that are no objects are left out."""
    lines = spark.read.text(path).filter(F.trim("value").startswith("{"))
    parsed = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.expr("try_parse_json(value)").isNotNull().alias("ok"))
    return parsed.filter("ok").select("r.*")


# Names that question lists use for one column.
CQ_COLUMNS = {"id": ["CQ_ID", "cq_id", "CQ-ID", "id", "ID"], "question": ["Refactored CQ", "Question", "question", "CQ"], "beats": ["Beats", "Beats (normalized list)", "beats"], "modes": ["RetrievalMode", "Mode", "mode"]}


def read_cq_csv(spark: SparkSession, path: str) -> DataFrame:
    """Questions (id, question, beats, modes) whatever their columns are called."""
    rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    picked = {}
    for name, choices in CQ_COLUMNS.items():
        have = [F.col(f"`{c}`") for c in choices if c in rows.columns]
        picked[name] = F.coalesce(*have) if have else F.lit(None).cast("string")
    out = rows.select(*(c.alias(n) for n, c in picked.items())).filter("id is not null")
    return out.withColumns({c: listed(F.col(c)) for c in ("beats", "modes")})


def listed(c):
    """An array from JSON or bracketed lists, or from text with ``;``, ``|`` or ``,`` between items."""
    bare = F.regexp_replace(F.trim(c), r"^\[|\]$", "")
    parts = F.filter(F.transform(F.split(bare, r"[;|,]"), lambda x: F.regexp_replace(F.trim(x), r"^['\"]|['\"]$", "")), lambda x: x != "")
    return F.coalesce(F.from_json(c, "array<string>"), parts, F.array().cast("array<string>"))


def cq_records(text: str) -> list[dict]:
    """Question records from JSON that is a list, {"cqs": [...]}, {"order": ..., "metadata": {...}} or {id: record}."""
    data = json.loads(text)
    if isinstance(data, dict):
        if isinstance(data.get("cqs"), list):
            data = data["cqs"]
        else:
            by_id = data.get("metadata", data)
            data = [{"id": k, **by_id[k]} for k in data.get("order", by_id) if isinstance(by_id.get(k), dict)]
    return [r for r in data if isinstance(r, dict)]


def read_urls(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """New urls of a list, one a line, comments left out."""
    urls = spark.read.text(path).select(F.trim("value").alias("url")).filter(F.col("url").rlike("^https?://")).distinct()
    urls = urls.join(known.select("url"), "url", "left_anti") if known is not None else urls
    return urls.withColumn("status", F.lit("NEW"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with rows of ``new`` in place of those with equal keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def prefer_summary(pages: DataFrame, least: int = 40) -> DataFrame:
    """The content of cached pages: the summary, or the text where the summary is short."""
    short = F.char_length(F.coalesce("summary", F.lit(""))) < least
    return pages.withColumn("content", F.when(short, F.coalesce("text", "summary")).otherwise(F.col("summary")))


def versions(spark: SparkSession, folder: str) -> list[tuple[int, int]]:
    """Versions vM.m in a folder of snapshots, in order."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted((int(m[1]), int(m[2])) for n in names if (m := re.fullmatch(r"v(\d+)\.(\d+)", n)))


def write_snapshot(df: DataFrame, folder: str, major: bool = False) -> str:
    """Write the next version; returns its path."""
    found = versions(df.sparkSession, folder)
    last = found[-1] if found else (0, 0)
    path = f"{folder}/v{last[0] + 1}.0" if major or not found else f"{folder}/v{last[0]}.{last[1] + 1}"
    df.write.parquet(path)
    return path


def read_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The latest version."""
    found = versions(spark, folder)
    if not found:
        raise AnalysisException(f"no snapshot in {folder}")
    return spark.read.parquet(f"{folder}/v{found[-1][0]}.{found[-1][1]}")
