"""Banks of query templates: splitting, binding, guarding, and running them as one frame."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.compiler import Compiler
from graphloom.plans.parser import QueryError, parse

_HEADER = re.compile(r"^[ \t]*#[ \t]*CQ-ID[ \t]*:[ \t]*(?P<head>.*)$", re.MULTILINE)
_LEFT = re.compile(r"\{\s*[A-Za-z]\w*\s*\}|\[[A-Za-z]\w*\]")


def split_bank(text: str, strict: bool = False) -> list[tuple[str, str, str]]:
    """(id, title, query) of every section. An id is the header's first word; ``strict`` refuses repeated ids."""
    heads = list(_HEADER.finditer(text))
    out = []
    for h, end in zip(heads, [*(x.start() for x in heads[1:]), len(text)]):
        cq, _, title = h["head"].strip().partition(" ")
        cq = cq.removeprefix("CQ-ID:").strip()
        query = text[h.end() : end].strip()
        if cq and query:
            out.append((cq, title.strip(), query))
    if strict and len({x[0] for x in out}) < len(out):
        raise QueryError("error", "an id occurs twice")
    return out


def bind(text: str, values: dict[str, str]) -> str:
    """Replaces ``{key}`` and ``[key]``, longer keys first, case respected."""
    for key in sorted(values, key=len, reverse=True):
        text = re.sub(r"\{\s*" + re.escape(key) + r"\s*\}|\[" + re.escape(key) + r"\]", lambda _: values[key], text)
    return text


def leftovers(text: str) -> list[str]:
    """Placeholders that are still there."""
    return list(dict.fromkeys(m[0] for m in _LEFT.finditer(text)))


def ensure_limit(text: str, n: int) -> str:
    return text if re.search(r"\bLIMIT\s+\d+", text, re.IGNORECASE) else f"{text.rstrip()}\nLIMIT {n}"


def ensure_prefixes(text: str, prefixes: dict[str, str]) -> str:
    """Declares all prefixes where a query declares none."""
    if re.search(r"^\s*PREFIX\s", text, re.IGNORECASE | re.MULTILINE):
        return text
    return "".join(f"PREFIX {p}: <{ns}>\n" for p, ns in prefixes.items()) + text


def classify(error: Exception) -> str:
    """One word for why a query failed: timeout, missing_prefix, bad_iri, unbound_variable, syntax, unknown_term, error."""
    if isinstance(error, QueryError):
        return error.kind
    said = str(error).lower()
    if "timeout" in said or "cancelled" in said:
        return "timeout"
    if "unresolved_column" in said:
        return "unbound_variable"
    return "error"


def run_bank(triples: DataFrame, bank: Iterable[tuple[str, str, str]], values: dict[str, str], prefixes: dict[str, str] | None = None, limit: int | None = None) -> DataFrame:
    """(cq_id, status, row): every query of a bank in one frame; rows as maps, since columns differ.

    Queries that do not compile give one row that says why. All run as one job.
    """
    compiler = Compiler(triples)
    parts = []
    for cq, _, query in bank:
        text = ensure_prefixes(bind(query, values), prefixes or {})
        try:
            if left := leftovers(text):
                raise QueryError("unbound_variable", " ".join(left))
            df = compiler.compile(parse(ensure_limit(text, limit) if limit else text, prefixes))
            pairs = [x for c in df.columns for x in (F.lit(c), F.col(c).cast("string"))]
            parts.append(df.select(F.lit(cq).alias("cq_id"), F.lit("OK").alias("status"), F.create_map(*pairs).alias("row")))
        except QueryError as e:
            none = compiler.spark.range(1).select(F.lit(cq).alias("cq_id"), F.lit(classify(e)).alias("status"), F.lit(None).cast("map<string,string>").alias("row"))
            parts.append(none)
    return reduce(DataFrame.unionByName, parts)


def coverage(results: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows and status per id; ids without a query have status MISSING."""
    got = results.groupBy("cq_id").agg(F.count("row").alias("rows"), F.max("status").alias("status"))
    return ids.select("cq_id").distinct().join(got, "cq_id", "left").select("cq_id", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("status", F.lit("MISSING")).alias("status"))
