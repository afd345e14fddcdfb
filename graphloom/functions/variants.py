"""Strings, numbers and statements anywhere inside JSON texts, at any depth.

Texts are parsed to VARIANT once. A walk opens all containers of all rows one
level at a time, so its rounds are the depth of the deepest text, not the number
of values, and a text is never held by Python. What a level gives is written to
the shared folder before the next. Keys of an object come in the order of their
names, as VARIANT keeps them; ``at`` is the place of a value in the walk.

Texts that are null or no JSON give no rows (``unparsed`` lists them). A key that
holds dots looks like a path of several keys; of equal paths the last counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.lineage import cut

# Names under which the parts of a statement are looked for, in this order; then s, p and o inside "triple".
SUBJECT, PREDICATE, OBJECT = ["subject", "s", "head"], ["predicate", "p", "rel"], ["object", "o", "tail"]
# A line of three parts between arrows.
ARROWS = r"^\s*[-•]?\s*(.+?)\s*(?:→|->)\s*(.+?)\s*(?:→|->)\s*(.+?)\s*$"
NUMBER = r"^[+-]?([0-9]+(_[0-9]+)*(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?$"


def unparsed(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Keys and texts that are not null and no JSON."""
    return rows.filter(F.col(text).isNotNull() & F.try_parse_json(text).isNull()).select(key, text)


def walk(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, at, kind, v) of every value, containers included: path ``a.b[0].c``, kind as VARIANT names it."""
    spark = rows.sparkSession
    top = rows.select(F.col(key).alias("key"), F.lit("").alias("path"), F.array().cast("array<int>").alias("at"), F.try_parse_json(text).alias("v")).filter("v is not null")
    level = cut(top.withColumn("kind", F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0)))
    out = level
    while not level.filter("kind in ('OBJECT', 'ARRAY')").isEmpty():
        inner = spark.sql(
            """SELECT key, CASE WHEN kind = 'ARRAY' THEN concat(path, '[', e.pos, ']') WHEN path = '' THEN e.name ELSE concat(path, '.', e.name) END AS path,
                 concat(at, array(e.pos)) AS at, e.value AS v FROM {level} AS l, LATERAL variant_explode(l.v) AS e(pos, name, value) WHERE kind IN ('OBJECT', 'ARRAY')""",
            level=level,
        )
        level = cut(inner.withColumn("kind", F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0)))
        out = out.unionByName(level)
    return out.select("key", "path", "at", "kind", "v")


def text_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def flat_numbers(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, value) of every finite number below the top, booleans as 1 and 0, and strings that read as numbers."""
    at = walk(rows, key, text).filter("path <> '' and kind not in ('OBJECT', 'ARRAY', 'VOID')")
    trimmed = F.regexp_replace(text_of(F.col("v")), r"^\s+|\s+$", "")
    said = F.when(F.col("kind") != "STRING", F.try_variant_get("v", "$", "double")).when(trimmed.rlike(NUMBER), F.replace(trimmed, F.lit("_"), F.lit("")).try_cast("double"))
    value = F.when(F.col("kind") == "BOOLEAN", F.try_variant_get("v", "$", "boolean").cast("double")).otherwise(said)
    found = at.select("key", "path", "at", value.alias("value")).filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    return found.groupBy("key", "path").agg(F.max_by("value", "at").alias("value"))


def texts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, at) of the different strings of each row, white space evened, empty ones left out; ``at`` is the first place."""
    even = F.trim(F.regexp_replace(text_of(F.col("v")), r"\s+", " "))
    found = walk(rows, key, text).filter("kind = 'STRING'").select("key", "at", even.alias("text")).filter("text <> ''")
    return found.groupBy("key", "text").agg(F.min("at").alias("at"))


def arrow_lines(text: Column) -> Column:
    """Array of (s, p, o) of the lines of a text that are three parts between arrows; quotes around a part go."""
    bare = lambda line, k: F.btrim(F.regexp_extract(line, ARROWS, k), F.lit(" \t\"'"))
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85  ]"), lambda x: x.rlike(ARROWS))
    found = F.transform(lines, lambda x: F.struct(bare(x, 1).alias("s"), bare(x, 2).alias("p"), bare(x, 3).alias("o")))
    return F.filter(found, lambda t: (t["s"] != "") & (t["o"] != ""))


def statements(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, at, pos, s, p, o) of everything in a row that states something.

    Objects with a subject and an object under one of their names, ``value`` of
    facts and triples as three parts between bars, and lines between arrows of
    text evidence. Parts that are no strings are written as JSON.
    """
    objects = walk(rows, key, text).filter("kind = 'OBJECT'")
    one = lambda path: F.nullif(F.try_variant_get("v", path, "string"), F.lit(""))
    part = lambda names, short: F.coalesce(*(one(f"$.{n}") for n in names), one(f"$.triple.{short}"))
    s, p, o = (part(n, x) for n, x in ((SUBJECT, "s"), (PREDICATE, "p"), (OBJECT, "o")))
    own = F.when(s.isNotNull() & o.isNotNull(), F.array(F.struct(s.alias("s"), F.coalesce(p, F.lit("")).alias("p"), o.alias("o"))))
    value, kind = F.try_variant_get("v", "$.value", "string"), F.lower(F.coalesce(F.try_variant_get("v", "$.type", "string"), F.lit("")))
    bars = F.transform(F.split(value, r"\|"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    barred = F.when(value.contains("|") & kind.isin("fact", "triple"), F.when(F.size(bars) == 3, F.array(F.struct(bars[0].alias("s"), bars[1].alias("p"), bars[2].alias("o")))))
    none = F.array().cast("array<struct<s:string,p:string,o:string>>")
    lines = F.when((kind == "text") & ~F.coalesce(value.contains("|") & kind.isin("fact", "triple"), F.lit(False)), arrow_lines(value))
    found = objects.select("key", "at", F.concat(F.coalesce(own, none), F.coalesce(barred, none), F.coalesce(lines, none)).alias("t"))
    return found.select("key", "at", F.posexplode("t").alias("pos", "x")).select("key", "at", "pos", "x.*")
