"""A relational star schema read as triples.

Every row is a node, every column a predicate. Triples of one predicate come
from one table, as literals that Catalyst folds: a query's filter on ``p``
removes all other branches of the union before anything is read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.terms import EX, RDFS, SCHEMA, TYPE, XSD, statement

NAME = SCHEMA + "name"


def node(kind: str, *keys: str) -> Column:
    """IRI of a row: its table and its key columns."""
    return F.concat(F.lit(f"{EX}{kind}/"), F.concat_ws("-", *(F.col(k).cast("string") for k in keys)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Table -> (class, key columns, {predicate: (column, kind or datatype)}); "@table" makes a link.
STAR = {
    "region": ("Region", ["r_regionkey"], {NAME: ("r_name", "")}),
    "nation": ("Nation", ["n_nationkey"], {NAME: ("n_name", ""), EX + "inRegion": ("n_regionkey", "@region")}),
    "customer": ("Customer", ["c_custkey"], {NAME: ("c_name", ""), EX + "inNation": ("c_nationkey", "@nation"), EX + "segment": ("c_mktsegment", ""), EX + "balance": ("c_acctbal", "double")}),
    "supplier": ("Supplier", ["s_suppkey"], {NAME: ("s_name", ""), EX + "inNation": ("s_nationkey", "@nation"), EX + "balance": ("s_acctbal", "double")}),
    "part": ("Part", ["p_partkey"], {NAME: ("p_name", ""), EX + "brand": ("p_brand", ""), EX + "partType": ("p_type", ""), EX + "size": ("p_size", "integer")}),
    "orders": ("Order", ["o_orderkey"], {EX + "placedBy": ("o_custkey", "@customer"), EX + "status": ("o_orderstatus", ""), EX + "priority": ("o_orderpriority", ""), EX + "orderDate": ("o_orderdate", "date"), EX + "totalPrice": ("o_totalprice", "double")}),
    "lineitem": ("LineItem", ["l_orderkey", "l_linenumber"], {EX + "ofOrder": ("l_orderkey", "@orders"), EX + "item": ("l_partkey", "@part"), EX + "suppliedBy": ("l_suppkey", "@supplier"), EX + "quantity": ("l_quantity", "double"), EX + "returnFlag": ("l_returnflag", "")}),
}


def table_triples(spark: SparkSession, sf_dir: str, name: str, predicates: set[str] | None = None) -> list[DataFrame]:
    return row_triples(table(spark, sf_dir, name), name, predicates)


def row_triples(df: DataFrame, name: str, predicates: set[str] | None = None) -> list[DataFrame]:
    """Triples of some rows of a table."""
    kind, keys, columns = STAR[name]
    subject = node(name, *keys)
    out = [statement(df, subject, TYPE, F.lit(EX + kind))] if predicates is None or TYPE in predicates else []
    for p, (column, how) in columns.items():
        if predicates is not None and p not in predicates:
            continue
        if how.startswith("@"):
            target = F.when(F.col(column).isNotNull(), node(how[1:], column))
            out.append(statement(df, subject, p, target))
        else:
            value = F.date_format(column, "yyyy-MM-dd") if how == "date" else F.col(column)
            out.append(statement(df, subject, p, value, "lit", XSD + how if how else ""))
    return out


#: Statements about the classes themselves.
SCHEMA_EDGES = [("Customer", "Party"), ("Supplier", "Party"), ("Party", "Agent"), ("Region", "Place"), ("Nation", "Place")]


def star_as_triples(spark: SparkSession, sf_dir: str, tables: list[str] | None = None, predicates: set[str] | None = None, distinct: bool = False) -> DataFrame:
    """Triples of the tables. Keys are unique, so the rows already are a set; ``distinct`` enforces it where they may not be."""
    parts = [t for name in tables or STAR for t in table_triples(spark, sf_dir, name, predicates)]
    if predicates is None or RDFS + "subClassOf" in predicates:
        rows = [(EX + a, EX + b) for a, b in SCHEMA_EDGES]
        parts.append(statement(spark.createDataFrame(rows, "a string, b string"), F.col("a"), RDFS + "subClassOf", F.col("b")))
    out = reduce(DataFrame.unionByName, parts)
    return out.dropDuplicates() if distinct else out
