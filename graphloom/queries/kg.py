"""Profiles, validation, curation and graph retrieval on the star schema, with relational SQL as oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom import terms as T
from graphloom.operators import closure, collections, context, curate, graph, profile, rules, validate
from graphloom.sources.star import NAME, STAR, node, star_as_triples, table
from graphloom.terms import EX, XSD

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


EVERY = list(STAR)
#: Rows (predicate, table, column, extra condition) of the triples made from the tables above, for the oracles.
_COUNTS = " UNION ALL ".join(
    f"SELECT '{p}' AS p, count({c[0]}) AS n FROM {t}" for t in EVERY for p, c in STAR[t][2].items()
)


@query(f"SELECT p, CAST(sum(n) AS BIGINT) AS n FROM ({_COUNTS} UNION ALL SELECT '{T.SUBCLASS}', 5) GROUP BY p")
def profile_predicates(spark, d):
    return profile.predicate_counts(star_as_triples(spark, d, EVERY))


@query(" UNION ALL ".join(f"SELECT '{EX}{STAR[t][0]}' AS cls, count(DISTINCT ({', '.join(STAR[t][1])},)) AS n FROM {t}" for t in EVERY))
def profile_classes(spark, d):
    return profile.class_counts(star_as_triples(spark, d, EVERY))


@query(" UNION ALL ".join(f"SELECT '{EX}{STAR[t][0]}' AS cls, '{p}' AS p, count({c[0]}) AS n FROM {t}" for t in EVERY for p, c in STAR[t][2].items()))
def profile_class_predicate(spark, d):
    return profile.class_predicate_counts(star_as_triples(spark, d, EVERY))


def _typed(spark, d):
    """Customers and suppliers, with the classes of what they hold as second types."""
    base = star_as_triples(spark, d, ["customer", "supplier"])
    rich = base.filter((F.col("p") == EX + "balance") & (F.col("o").cast("double") > 5000))
    return T.union(base, T.statement(rich, F.col("s"), T.TYPE, F.lit(EX + "Rich")), T.statement(base.filter(F.col("p") == EX + "segment"), F.col("s"), T.TYPE, F.concat(F.lit(EX), F.col("o"))))


_TYPED_SQL = f"""typed AS (SELECT 'c' || c_custkey AS k, '{EX}Customer' AS cls FROM customer UNION SELECT 'c' || c_custkey, '{EX}Rich' FROM customer WHERE c_acctbal > 5000
  UNION SELECT 'c' || c_custkey, '{EX}' || c_mktsegment FROM customer UNION SELECT 's' || s_suppkey, '{EX}Supplier' FROM supplier UNION SELECT 's' || s_suppkey, '{EX}Rich' FROM supplier WHERE s_acctbal > 5000)"""


@query(f"WITH {_TYPED_SQL} SELECT x.cls AS a, y.cls AS b, count(*) AS n FROM typed x JOIN typed y ON x.k = y.k AND x.cls <= y.cls GROUP BY 1, 2")
def profile_cotyping(spark, d):
    return profile.cotyping(_typed(spark, d))


@query(f"WITH {_TYPED_SQL}, c AS (SELECT k, string_agg(cls, ' ' ORDER BY cls) AS classes FROM typed GROUP BY k) SELECT classes, count(*) AS n FROM c GROUP BY 1")
def profile_combos(spark, d):
    return profile.type_combinations(_typed(spark, d))


_WANTED = [NAME, EX + "balance", EX + "brand"]


@query(
    f"""WITH m AS (SELECT '{EX}Customer' AS cls, count(*) AS members, count(c_name) AS a, count(c_acctbal) AS b, 0 AS c FROM customer
        UNION ALL SELECT '{EX}Supplier', count(*), count(s_name), count(s_acctbal), 0 FROM supplier UNION ALL SELECT '{EX}Part', count(*), count(p_name), 0, count(p_brand) FROM part)
    SELECT cls, '{NAME}' AS p, members, round(100.0 * a / members, 1) AS pct FROM m UNION ALL SELECT cls, '{EX}balance', members, round(100.0 * b / members, 1) FROM m
    UNION ALL SELECT cls, '{EX}brand', members, round(100.0 * c / members, 1) FROM m"""
)
def coverage_pct(spark, d):
    return profile.coverage(star_as_triples(spark, d, ["customer", "supplier", "part"]), _WANTED)


@query("SELECT 'http://example.org/customer/' || c_custkey AS s, CAST(c_name IS NOT NULL AS INT) AS has_0, CAST(c_acctbal IS NOT NULL AS INT) AS has_1, 0 AS has_2 FROM customer")
def coverage_rows(spark, d):
    return profile.coverage_rows(star_as_triples(spark, d, ["customer", "part"]), EX + "Customer", _WANTED)


@query(
    """SELECT (SELECT 2 * count(*) + count(r_name) - count(*) FROM region) + (SELECT count(*) + count(n_name) + count(n_regionkey) FROM nation) + 5 AS triples,
       (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + 5 AS subjects, CAST(4 AS BIGINT) AS properties,
       (SELECT count(DISTINCT r_name) FROM region) + (SELECT count(DISTINCT n_name) FROM nation) + (SELECT count(DISTINCT n_regionkey) FROM nation) + 5 AS objects, CAST(2 AS BIGINT) AS classes"""
)
def void_counts(spark, d):
    t = star_as_triples(spark, d, ["region", "nation"])
    place = T.statement(spark.createDataFrame([(EX + "Region",), (EX + "Nation",)], "a string"), F.col("a"), T.SUBCLASS, F.lit(EX + "Place"))
    return profile.void_counts(t.unionByName(place).dropDuplicates())


@query(
    f"""WITH v AS (SELECT '{EX}brand' AS p, p_partkey AS s, p_brand AS o FROM part UNION ALL SELECT '{EX}partType', p_partkey, p_type FROM part UNION ALL SELECT '{EX}size', p_partkey, CAST(p_size AS VARCHAR) FROM part),
       r AS (SELECT p, o, row_number() OVER (PARTITION BY p ORDER BY o) AS r FROM (SELECT DISTINCT p, o FROM v))
    SELECT p, subjects, objects, examples FROM (SELECT p, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects FROM v GROUP BY p)
    JOIN (SELECT p, string_agg(o, '|' ORDER BY r) AS examples FROM r WHERE r <= 3 GROUP BY p) USING (p)"""
)
def predicate_summary(spark, d):
    t = star_as_triples(spark, d, ["part"], {EX + "brand", EX + "partType", EX + "size"})
    return profile.predicate_summary(t)


@query(
    f"""SELECT * FROM (VALUES ('{EX}placedBy', 'object', '{EX}Order', '{EX}Customer'), ('{EX}totalPrice', 'datatype', '{EX}Order', '{XSD}double'), ('{EX}orderDate', 'datatype', '{EX}Order', '{XSD}date'),
      ('{EX}status', 'datatype', '{EX}Order', '{XSD}string'), ('{EX}priority', 'datatype', '{EX}Order', '{XSD}string'), ('{NAME}', 'datatype', '{EX}Customer', '{XSD}string'),
      ('{EX}segment', 'datatype', '{EX}Customer', '{XSD}string'), ('{EX}balance', 'datatype', '{EX}Customer', '{XSD}double'), ('{EX}inNation', 'object', '{EX}Customer', NULL)) t(p, kind, domain, "range")"""
)
def schema_inferred(spark, d):
    return profile.inferred_schema(star_as_triples(spark, d, ["customer", "orders"]).filter(F.col("p") != T.SUBCLASS))


@query(
    f"""WITH s AS (SELECT '{EX}Supplier' AS classes, concat_ws(' ', CASE WHEN s_acctbal > 0 THEN '{EX}balance' END, '{EX}inNation', '{NAME}') AS properties FROM supplier)
    SELECT classes, properties, count(*) AS n FROM s GROUP BY 1, 2 HAVING count(*) >= 2"""
)
def structural_clusters(spark, d):
    t = star_as_triples(spark, d, ["supplier"]).filter((F.col("p") != T.SUBCLASS) & ((F.col("p") != EX + "balance") | (F.col("o").cast("double") > 0)))
    return profile.structural_clusters(t)


_TRIPLES = " + ".join(f"(SELECT count(*) + {' + '.join(f'count({c[0]})' for c in STAR[t][2].values())} FROM {t})" for t in EVERY)
_DISTINCT = " + ".join(f"(SELECT count(DISTINCT ({', '.join(STAR[t][1])},)){''.join(f' + count(DISTINCT ({chr(44).join(STAR[t][1])}, {c[0]})) FILTER ({c[0]} IS NOT NULL)' for c in STAR[t][2].values())} FROM {t})" for t in EVERY)
_IRI = lambda kind, keys: f"'{kind}/' || concat_ws('-', {', '.join(keys)})"
_LINKED = " UNION ".join(f"SELECT {_IRI(c[1][1:], [c[0]])} AS o FROM {t} WHERE {c[0]} IS NOT NULL" for t in EVERY for c in STAR[t][2].values() if c[1].startswith("@"))
_NODES = " UNION ".join(f"SELECT {_IRI(t, STAR[t][1])} FROM {t}" for t in EVERY)


@query(
    f"""SELECT CAST({_TRIPLES} AS BIGINT) AS triples, CAST(0 AS BIGINT) AS untyped_numbers, CAST(0 AS BIGINT) AS with_bnodes,
       CAST(0 AS BIGINT) AS untyped_nodes, CAST(({_TRIPLES}) - ({_DISTINCT}) AS BIGINT) AS repeated, (SELECT count(*) FROM ({_LINKED} EXCEPT ({_NODES}))) AS dangling"""
)
def health_summary(spark, d):
    return profile.star_health(spark, d, EVERY)


# --- validation ---


@query(
    f"""SELECT 'error' AS severity, 'FUNCTIONAL_VIOLATION' AS code, 'http://example.org/orders/' || l_orderkey AS s, '{EX}shippedBy' AS p, CAST(count(DISTINCT l_suppkey) AS VARCHAR) AS detail
    FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) > 1"""
)
def functional_violation(spark, d):
    lines = table(spark, d, "lineitem")
    return validate.functional_violation(T.statement(lines, node("orders", "l_orderkey"), EX + "shippedBy", node("supplier", "l_suppkey")), [EX + "shippedBy"])


@query(
    f"""SELECT 'error' AS severity, 'CARDINALITY' AS code, 'http://example.org/customer/' || c_custkey AS s, '{EX}placed' AS p, CAST(count(o_orderkey) AS VARCHAR) AS detail
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) < 1 OR count(o_orderkey) > 15"""
)
def cardinality_violation(spark, d):
    placed = T.statement(table(spark, d, "orders"), node("customer", "o_custkey"), EX + "placed", node("orders", "o_orderkey"))
    return validate.cardinality_violation(star_as_triples(spark, d, ["customer"]).unionByName(placed), EX + "Customer", EX + "placed", 1, 15)


def _schema(spark):
    rows = [
        (EX + "Customer", T.SUBCLASS, EX + "Party"), (EX + "Supplier", T.SUBCLASS, EX + "Party"), (EX + "inNation", T.RDFS + "domain", EX + "Party"), (EX + "inNation", T.RDFS + "range", EX + "Nation"),
        (EX + "placedBy", T.RDFS + "domain", EX + "Order"), (EX + "placedBy", T.RDFS + "range", EX + "Customer"), (EX + "balance", T.RDFS + "domain", EX + "Customer"), (EX + "balance", T.RDFS + "range", XSD + "decimal"),
        (EX + "inNation", T.TYPE, T.OWL + "ObjectProperty"), (EX + "placedBy", T.TYPE, T.OWL + "ObjectProperty"), (EX + "balance", T.TYPE, T.OWL + "DatatypeProperty"), (EX + "segment", T.TYPE, T.OWL + "ObjectProperty"),
        (NAME, T.TYPE, T.OWL + "DatatypeProperty"),
    ]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    return df.select(F.col("a").alias("s"), F.col("b").alias("p"), F.col("c").alias("o"), F.lit("iri").alias("s_kind"), F.lit("iri").alias("o_kind"), F.lit("").alias("o_dt"), F.lit("").alias("o_lang"))


@query(f"SELECT 'error' AS severity, 'DOMAIN_VIOLATION' AS code, 'http://example.org/supplier/' || s_suppkey AS s, '{EX}balance' AS p, '{EX}Customer' AS detail FROM supplier WHERE s_acctbal IS NOT NULL")
def domain_violation(spark, d):
    return validate.domain_violation(star_as_triples(spark, d, ["customer", "supplier", "orders"]), _schema(spark))


@query(
    f"""SELECT 'error' AS severity, 'RANGE_DT_VIOLATION' AS code, 'http://example.org/supplier/' || s_suppkey AS s, '{EX}balance' AS p, CAST(s_acctbal AS VARCHAR) AS detail FROM supplier
    UNION ALL SELECT 'warning', 'RANGE_UNTYPED', 'http://example.org/supplier/' || s_suppkey, '{EX}inNation', 'http://example.org/nation/' || s_nationkey FROM supplier"""
)
def range_violation(spark, d):
    return validate.range_violation(star_as_triples(spark, d, ["supplier"]), _schema(spark))


@query(f"SELECT 'error' AS severity, 'PROPERTY_TYPE_MISMATCH' AS code, 'http://example.org/customer/' || c_custkey AS s, '{EX}segment' AS p, c_mktsegment AS detail FROM customer")
def property_type_mismatch(spark, d):
    return validate.property_type_mismatch(star_as_triples(spark, d, ["customer"]), _schema(spark))


@query(f"SELECT 'warning' AS severity, 'UNKNOWN_PROPERTY' AS code, CAST(NULL AS VARCHAR) AS s, p, CAST(n AS VARCHAR) AS detail FROM (SELECT '{EX}status' AS p, count(o_orderstatus) AS n FROM orders UNION ALL SELECT '{EX}priority', count(o_orderpriority) FROM orders UNION ALL SELECT '{EX}orderDate', count(o_orderdate) FROM orders UNION ALL SELECT '{EX}totalPrice', count(o_totalprice) FROM orders)")
def unknown_property(spark, d):
    return validate.unknown_property(star_as_triples(spark, d, ["orders"]), _schema(spark))


@query("SELECT 'http://example.org/part/' || l_partkey AS o, count(*) AS uses FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey) OR l_partkey % 10 = 0 GROUP BY 1")
def dangling_objects(spark, d):
    parts = star_as_triples(spark, d, ["part"]).filter(~F.col("s").endswith("0"))
    lines = T.statement(table(spark, d, "lineitem"), node("lineitem", "l_orderkey", "l_linenumber"), EX + "item", node("part", "l_partkey"))
    return profile.dangling_objects(parts.unionByName(lines)).filter(F.col("o").startswith(EX + "part/"))


@query(
    f"""SELECT 'error' AS severity, 'SHAPE_MIN_INCLUSIVE' AS code, 'http://example.org/customer/' || c_custkey AS s, '{EX}balance' AS p, CAST(c_acctbal AS VARCHAR) AS detail FROM customer WHERE c_acctbal < 0
    UNION ALL SELECT 'error', 'SHAPE_MIN_INCLUSIVE', 'http://example.org/supplier/' || s_suppkey, '{EX}balance', CAST(s_acctbal AS VARCHAR) FROM supplier WHERE s_acctbal < 0
    UNION ALL SELECT 'error', 'SHAPE_MAX_COUNT', 'http://example.org/customer/' || c_custkey, '{EX}balance', '1' FROM customer
    UNION ALL SELECT 'error', 'SHAPE_MAX_COUNT', 'http://example.org/supplier/' || s_suppkey, '{EX}balance', '1' FROM supplier"""
)
def shape_checks(spark, d):
    shape = validate.Shape(EX + "Party", EX + "balance", min_count=1, max_count=0, node_kind="Literal", datatype=XSD + "double", min_inclusive=0)
    return validate.check_shape(star_as_triples(spark, d, ["customer", "supplier"]), _schema(spark), shape)


@query(f"SELECT '{EX}' || t AS term, 'property' AS role, count(*) AS uses FROM (SELECT 'status' AS t FROM orders UNION ALL SELECT 'priority' FROM orders UNION ALL SELECT 'orderDate' FROM orders UNION ALL SELECT 'totalPrice' FROM orders) GROUP BY 1 UNION ALL SELECT '{EX}Order', 'class', count(*) FROM orders")
def unknown_vocabulary(spark, d):
    return validate.unknown_vocabulary(star_as_triples(spark, d, ["orders"]), _schema(spark), [T.RDF, T.RDFS, T.OWL])


_RULES = [
    (EX + "inNation", T.RDFS + "domain", "_:parties"), ("_:parties", T.OWL + "unionOf", "_:l1"), ("_:l1", T.RDF + "first", EX + "Customer"), ("_:l1", T.RDF + "rest", "_:l2"),
    ("_:l2", T.RDF + "first", EX + "Supplier"), ("_:l2", T.RDF + "rest", T.RDF + "nil"), (EX + "inNation", T.RDFS + "range", EX + "Nation"),
    (EX + "balance", T.SCHEMA + "domainIncludes", EX + "Client"), (EX + "Client", T.OWL + "equivalentClass", EX + "Customer"), (EX + "balance", T.SCHEMA + "rangeIncludes", XSD + "double"),
    (EX + "segment", T.SCHEMA + "domainIncludes", EX + "Party"), (EX + "segment", T.SCHEMA + "rangeIncludes", T.SCHEMA + "Text"), (NAME, T.SCHEMA + "rangeIncludes", T.SCHEMA + "URL"),
    (EX + "status", T.RDFS + "domain", EX + "Order"), (EX + "status", T.RDFS + "range", XSD + "integer"), (EX + "totalPrice", T.SUBPROPERTY, EX + "amount"), (EX + "amount", T.RDFS + "domain", EX + "Invoice"),
    (EX + "totalPrice", T.RDFS + "range", T.RDFS + "Literal"), (EX + "placedBy", T.RDFS + "domain", EX + "Order"), (EX + "placedBy", T.SCHEMA + "rangeIncludes", EX + "Supplier"), (EX + "placedBy", T.RDFS + "range", EX + "Nation"),
    (EX + "Customer", T.SUBCLASS, EX + "Party"), (EX + "Supplier", T.SUBCLASS, EX + "Party"),
]


def _rules(spark):
    df = spark.createDataFrame(_RULES, "a string, b string, c string")
    kind = lambda c: F.when(F.col(c).startswith("_:"), F.lit("bnode")).otherwise(F.lit("iri"))
    bare = lambda c: F.regexp_replace(c, "^_:", "")
    return df.select(bare("a").alias("s"), F.col("b").alias("p"), bare("c").alias("o"), kind("a").alias("s_kind"), kind("c").alias("o_kind"), F.lit("").alias("o_dt"), F.lit("").alias("o_lang"))


_ISSUES = f"""SELECT 'error' AS severity, 'domain_mismatch' AS code, '{EX}balance' AS property, '{EX}supplier/' || s_suppkey AS subject, CAST(s_acctbal AS VARCHAR) AS object, '{EX}Supplier' AS subject_types, '' AS object_types, '' AS object_datatype, '{EX}Client' AS expected FROM supplier WHERE s_acctbal IS NOT NULL
    UNION ALL SELECT 'warn', 'object_untyped', '{EX}inNation', '{EX}supplier/' || s_suppkey, '{EX}nation/' || s_nationkey, '', '', '', '{EX}Nation' FROM supplier WHERE s_nationkey IS NOT NULL
    UNION ALL SELECT 'warn', 'object_untyped', '{EX}inNation', '{EX}customer/' || c_custkey, '{EX}nation/' || c_nationkey, '', '', '', '{EX}Nation' FROM customer WHERE c_nationkey IS NOT NULL
    UNION ALL SELECT 'info', 'domain_unknown', '{NAME}', '{EX}supplier/' || s_suppkey, s_name, '', '', '', '' FROM supplier WHERE s_name IS NOT NULL
    UNION ALL SELECT 'info', 'domain_unknown', '{NAME}', '{EX}customer/' || c_custkey, c_name, '', '', '', '' FROM customer WHERE c_name IS NOT NULL
    UNION ALL SELECT 'error', 'range_mismatch_literal', '{NAME}', '{EX}supplier/' || s_suppkey, s_name, '', '', '{XSD}string', 'http://schema.org/URL' FROM supplier WHERE s_name IS NOT NULL
    UNION ALL SELECT 'error', 'range_mismatch_literal', '{NAME}', '{EX}customer/' || c_custkey, c_name, '', '', '{XSD}string', 'http://schema.org/URL' FROM customer WHERE c_name IS NOT NULL
    UNION ALL SELECT 'error', 'range_mismatch_literal', '{EX}status', '{EX}orders/' || o_orderkey, o_orderstatus, '', '', '{XSD}string', '{XSD}integer' FROM orders WHERE o_orderstatus IS NOT NULL
    UNION ALL SELECT 'error', 'domain_mismatch', '{EX}totalPrice', '{EX}orders/' || o_orderkey, CAST(o_totalprice AS VARCHAR), '{EX}Order', '', '', '{EX}Invoice' FROM orders WHERE o_totalprice IS NOT NULL
    UNION ALL SELECT 'error', 'range_mismatch_iri', '{EX}placedBy', '{EX}orders/' || o_orderkey, '{EX}customer/' || o_custkey, '', '{EX}Customer', '', '{EX}Nation|{EX}Supplier' FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'warn', 'object_untyped', '{EX}placedBy', '{EX}orders/' || o_orderkey, '{EX}customer/' || o_custkey, '', '', '', '{EX}Nation|{EX}Supplier' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'info', c, '{EX}priority', '{EX}orders/' || o_orderkey, o_orderpriority, '', '', '', '' FROM orders, (VALUES ('domain_unknown'), ('range_unknown')) t(c) WHERE o_orderpriority IS NOT NULL
    UNION ALL SELECT 'info', c, '{EX}orderDate', '{EX}orders/' || o_orderkey, strftime(o_orderdate, '%Y-%m-%d'), '', '', '', '' FROM orders, (VALUES ('domain_unknown'), ('range_unknown')) t(c) WHERE o_orderdate IS NOT NULL"""


def _judged(spark, d):
    return rules.check(star_as_triples(spark, d, ["customer", "supplier", "orders"]), _rules(spark))


@query(_ISSUES)
def schema_rules(spark, d):
    return _judged(spark, d)


@query(f"SELECT property, code, count(*) AS \"count\" FROM ({_ISSUES}) GROUP BY ALL")
def checklist_overview(spark, d):
    return rules.checklists(_judged(spark, d))["overview"]


@query(f"SELECT property, split_part(code, '_', 1) AS missing, count(*) AS triples FROM ({_ISSUES}) WHERE code LIKE '%unknown' GROUP BY ALL")
def checklist_missing_schema(spark, d):
    return rules.checklists(_judged(spark, d))["missing_schema"]


@query(f"SELECT code, property, 'object' AS who, object AS node, expected FROM ({_ISSUES}) WHERE code = 'object_untyped'")
def checklist_untyped_nodes(spark, d):
    return rules.checklists(_judged(spark, d))["untyped_nodes"]


def _order_lists(spark, d):
    """Every customer's orders as a collection: (triples, heads)."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    cell = F.concat(F.lit(EX + "cell/"), F.col("o_orderkey").cast("string"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", cell.alias("cell"), F.lead(cell).over(w).alias("next"), F.row_number().over(w).alias("r"))
    triples = T.statement(orders, F.col("cell"), collections.FIRST, node("orders", "o_orderkey")).unionByName(T.statement(orders, F.col("cell"), collections.REST, F.coalesce("next", F.lit(collections.NIL))))
    return triples, orders.filter("r = 1").select(F.col("cell").alias("head"))


@query(
    f"""SELECT '{EX}cell/' || min(o_orderkey) OVER (PARTITION BY o_custkey) AS head, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, '{EX}orders/' || o_orderkey AS item FROM orders"""
)
def list_members(spark, d):
    return collections.members(*_order_lists(spark, d)).select("head", "pos", "item")


# --- curation ---


@query("SELECT DISTINCT doc_id AS node, first AS canonical FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY lower(trim(text))) AS first FROM documents) WHERE doc_id <> first")
def dedupe_canonical(spark, d):
    docs = table(spark, d, "documents")
    members = docs.select(F.sha2(F.lower(F.trim("text")), 256).alias("key"), F.col("doc_id").alias("node"))
    return curate.canonical_map(members, docs.select(F.col("doc_id").alias("node"), F.lit(1).alias("degree")).distinct())


@query(
    f"""WITH m AS (SELECT s_suppkey, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS c FROM supplier), r AS (SELECT s_suppkey, (SELECT min('http://example.org/supplier/' || x.s_suppkey) FROM supplier x WHERE x.s_nationkey = s.s_nationkey) AS c FROM supplier s)
    SELECT DISTINCT c AS s, '{EX}inNation' AS p, 'http://example.org/nation/' || s_nationkey AS o FROM supplier JOIN r USING (s_suppkey)
    UNION SELECT c, '{NAME}', s_name FROM supplier JOIN r USING (s_suppkey)"""
)
def resolve_and_rewrite(spark, d):
    t = star_as_triples(spark, d, ["supplier"]).filter(F.col("p").isin(EX + "inNation", NAME, T.TYPE))
    return curate.dedupe_nodes(t, EX + "Supplier", [EX + "inNation"]).filter(F.col("p") != T.TYPE).select("s", "p", "o").distinct()


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 <> 0 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)")
def diff_missing(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return curate.missing(orders.filter("o_orderkey % 3 <> 0"), orders.filter("o_orderkey % 3 = 0"), ["o_custkey"])


@query(
    """WITH v AS (SELECT o_orderkey, o_orderkey % 4 AS k, CAST(o_orderdate AS DATE) AS d, o_orderdate AS ts FROM orders)
    SELECT o_orderkey, CAST(CASE k WHEN 0 THEN date_trunc('year', d) WHEN 1 THEN date_trunc('month', d) WHEN 2 THEN d ELSE date_trunc('second', ts) END AS TIMESTAMP) AS span_start,
      CAST(CASE k WHEN 0 THEN date_trunc('year', d) + INTERVAL 1 YEAR - INTERVAL 1 SECOND WHEN 1 THEN date_trunc('month', d) + INTERVAL 1 MONTH - INTERVAL 1 SECOND
        WHEN 2 THEN d + INTERVAL 1 DAY - INTERVAL 1 SECOND ELSE date_trunc('second', ts) END AS TIMESTAMP) AS span_end FROM v"""
)
def date_span_expand(spark, d):
    form = F.expr("CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, 'yyyy') WHEN 1 THEN date_format(o_orderdate, 'yyyy-MM') WHEN 2 THEN date_format(o_orderdate, 'yyyy-MM-dd') ELSE date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\") END")
    spans = table(spark, d, "orders").withColumn("span", T.date_span(form, F.lit("")))
    return spans.select("o_orderkey", *(F.col(f"span.{c}").cast("timestamp_ntz").alias(f"span_{c}") for c in ("start", "end")))


@query("SELECT l_orderkey, item, row_number() OVER (PARTITION BY l_orderkey ORDER BY p, item) AS position FROM (SELECT l_orderkey, l_suppkey % 5 AS item, min(l_linenumber) AS p FROM lineitem GROUP BY 1, 2)")
def setlist_renumber(spark, d):
    return curate.renumber(table(spark, d, "lineitem"), "l_orderkey", F.col("l_suppkey") % 5, F.col("l_linenumber"))


@query("SELECT c_mktsegment || CASE WHEN r = 1 THEN '' ELSE '_' || r END AS name, node FROM (SELECT lower(c_mktsegment) AS c_mktsegment, c_custkey AS node, row_number() OVER (PARTITION BY lower(c_mktsegment) ORDER BY c_custkey) AS r FROM customer)")
def unique_names(spark, d):
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("node"), "c_mktsegment")
    return curate.unique_names(nodes, curate.slug(F.col("c_mktsegment")))


@query("SELECT CAST(count(*) * 5 - count(*) FILTER (c_nationkey IS NULL) AS BIGINT) AS kept, (SELECT CAST(count(*) * 4 AS BIGINT) FROM supplier) AS other FROM customer")
def split_by_type(spark, d):
    own, other = curate.split_by_type(star_as_triples(spark, d, ["customer", "supplier"]).filter(F.col("p") != T.SUBCLASS), EX + "Customer")
    return own.agg(F.count("*").alias("kept")).join(other.agg(F.count("*").alias("other")))


@query(
    """SELECT 'http://example.org/lineitem/' || l_orderkey || '-' || l_linenumber AS s FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7)"""
)
def remove_cascade(spark, d):
    t = star_as_triples(spark, d, ["orders", "lineitem"], {EX + "placedBy", EX + "ofOrder"})
    gone = table(spark, d, "customer").filter("c_nationkey = 7").select(node("customer", "c_custkey").alias("node"))
    return curate.remove_cascade(t, gone, [EX + "placedBy", EX + "ofOrder"]).filter(F.col("p") == EX + "ofOrder").select("s")


@query("SELECT c_mktsegment AS s, string_agg(DISTINCT CAST(c_nationkey AS VARCHAR), ',' ORDER BY CAST(c_nationkey AS VARCHAR)) AS ids FROM customer GROUP BY 1")
def merge_provenance(spark, d):
    rows = table(spark, d, "customer").select(
        F.concat(F.lit(" "), "c_mktsegment").alias("s"), F.lit("p").alias("p"), F.lit("o ").alias("o"), F.array(F.col("c_nationkey").cast("string")).alias("cq_ids"), F.array(F.lit("x")).alias("sources"), F.lit("ok").alias("status")
    )
    return curate.merge_with_provenance(rows).select("s", F.array_join("cq_ids", ",").alias("ids"))


@query(
    """SELECT DISTINCT lower(trim(r)) AS role, p_partkey FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS r FROM part) WHERE trim(r) <> ''"""
)
def split_roles(spark, d):
    t = T.statement(table(spark, d, "part"), node("part", "p_partkey"), EX + "partType", F.col("p_type"), "lit")
    out = curate.split_roles(t, EX + "partType", EX + "role", " ")
    return out.filter(F.col("p") == T.LABEL).select(F.lower("o").alias("role"), F.regexp_extract("s", r"part/(\d+)_", 1).cast("bigint").alias("p_partkey")).distinct()


# --- graph ---


def _edges(spark, d):
    t = star_as_triples(spark, d, ["customer", "orders", "lineitem"], {EX + "placedBy", EX + "ofOrder", EX + "item"})
    return graph.edges_of(t)


_EDGES = f"""e AS (SELECT 'http://example.org/orders/' || o_orderkey AS src, '{EX}placedBy' AS predicate, 'http://example.org/customer/' || o_custkey AS dst FROM orders
  UNION ALL SELECT 'http://example.org/lineitem/' || l_orderkey || '-' || l_linenumber, '{EX}ofOrder', 'http://example.org/orders/' || l_orderkey FROM lineitem
  UNION ALL SELECT 'http://example.org/lineitem/' || l_orderkey || '-' || l_linenumber, '{EX}item', 'http://example.org/part/' || l_partkey FROM lineitem),
  b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)"""


@query(f"WITH {_EDGES}, s AS (SELECT 'http://example.org/customer/' || c_custkey AS node FROM customer WHERE c_nationkey = 3), h1 AS (SELECT DISTINCT b.dst AS node FROM b JOIN s ON b.src = s.node), h2 AS (SELECT DISTINCT b.dst AS node FROM b JOIN h1 ON b.src = h1.node) SELECT node, min(hop) AS hop FROM (SELECT node, 0 AS hop FROM s UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2) GROUP BY node")
def khop_2(spark, d):
    seeds = table(spark, d, "customer").filter("c_nationkey = 3").select(node("customer", "c_custkey").alias("node"))
    return graph.k_hop(_edges(spark, d), seeds, 2)


@query(f"WITH {_EDGES} SELECT src AS node, count(*) AS degree FROM b GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def degree_topk(spark, d):
    return graph.degree(_edges(spark, d)).orderBy(F.desc("degree"), "node").limit(20)


@query(
    f"""WITH {_EDGES}, s AS (SELECT 'http://example.org/customer/' || c_custkey AS node FROM customer WHERE c_nationkey = 3), deg AS (SELECT src AS node, count(*) AS degree FROM b GROUP BY 1),
    c AS (SELECT dst AS node, CASE predicate WHEN '{EX}placedBy' THEN 2.5 ELSE 1.0 END AS w FROM e WHERE src IN (SELECT node FROM s) UNION ALL SELECT src, CASE predicate WHEN '{EX}placedBy' THEN 2.5 ELSE 1.0 END FROM e WHERE dst IN (SELECT node FROM s))
    SELECT node, CAST(round(sum(w) + 0.1 * max(degree), 6) AS DOUBLE) AS score FROM c JOIN deg USING (node) WHERE node NOT IN (SELECT node FROM s) GROUP BY node ORDER BY sum(w) + 0.1 * max(degree) DESC, node LIMIT 15"""
)
def frontier_rank(spark, d):
    section = table(spark, d, "customer").filter("c_nationkey = 3").select(node("customer", "c_custkey").alias("node"))
    return graph.rank_frontier(_edges(spark, d), section, {EX + "placedBy": 2.5}, 15).withColumn("score", F.round("score", 6))


@query()
def lpa_communities(spark, d):
    lines = table(spark, d, "lineitem")
    e = lines.select(node("part", "l_partkey").alias("src"), node("supplier", "l_suppkey").alias("dst"))
    return graph.label_propagation(e, 3)


@query(
    f"""SELECT * FROM (VALUES ('{EX}Customer', '{EX}inNation', '{EX}Nation'), ('{EX}Supplier', '{EX}inNation', '{EX}Nation'), ('{EX}Nation', '{EX}inRegion', '{EX}Region'), ('{EX}Order', '{EX}placedBy', '{EX}Customer'), ('{EX}LineItem', '{EX}ofOrder', '{EX}Order'), ('{EX}LineItem', '{EX}item', '{EX}Part'), ('{EX}LineItem', '{EX}suppliedBy', '{EX}Supplier')) t(a, predicate, b)"""
)
def schema_outline(spark, d):
    return graph.schema_outline(star_as_triples(spark, d, EVERY))


@query(
    """WITH RECURSIVE r(a, node, hops) AS (SELECT 'http://example.org/supplier/' || s_suppkey, 'http://example.org/nation/' || s_nationkey, 1 FROM supplier
      UNION ALL SELECT a, 'http://example.org/region/' || n_regionkey, 2 FROM r JOIN nation ON node = 'http://example.org/nation/' || n_nationkey WHERE hops = 1) SELECT a AS start, node, hops FROM r"""
)
def reachability(spark, d):
    e = graph.edges_of(star_as_triples(spark, d, ["nation", "supplier"], {EX + "inNation", EX + "inRegion"}))
    seeds = table(spark, d, "supplier").select(node("supplier", "s_suppkey").alias("start"))
    return closure.reachable(e, seeds)


@query(
    f"""WITH {_EDGES}, s AS (SELECT DISTINCT src, predicate, dst, count(*) OVER (PARTITION BY predicate, src) + count(*) OVER (PARTITION BY predicate, dst) AS weight FROM e)
    SELECT src, predicate, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY predicate ORDER BY weight DESC, src, dst) AS r FROM s) WHERE r <= 10"""
)
def cap_edges_per_predicate(spark, d):
    return graph.top_edges_per_predicate(_edges(spark, d), 10)


@query("SELECT 'http://example.org/orders/' || o_orderkey AS node, CAST(year(o_orderdate) AS VARCHAR) AS year FROM orders")
def timeline_years(spark, d):
    return graph.timeline(star_as_triples(spark, d, ["orders"], {EX + "orderDate"}), EX + "orderDate")


@query()
def betweenness_small(spark, d):
    return graph.betweenness(graph.edges_of(star_as_triples(spark, d, ["nation", "supplier"], {EX + "inNation", EX + "inRegion"})))


# --- context of many sections ---


def _by_nation(spark, d):
    """Edges of nations, their people and orders; each nation is a section of itself and its region."""
    t = star_as_triples(spark, d, ["nation", "customer", "supplier", "orders"]).filter(F.col("p") != T.SUBCLASS)
    nations = table(spark, d, "nation").select(node("nation", "n_nationkey").alias("section"), F.explode(F.array(node("nation", "n_nationkey"), node("region", "n_regionkey"))).alias("node"))
    return t, graph.edges_of(t), nations


@query(
    f"""WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), v AS (SELECT c_nationkey AS n, '{EX}customer/' || c_custkey AS node, 1 + 0.1 * (1 + coalesce(o.n, 0)) AS score FROM customer LEFT JOIN o ON o_custkey = c_custkey
      UNION ALL SELECT s_nationkey, '{EX}supplier/' || s_suppkey, 1.1 FROM supplier UNION ALL SELECT a.n_nationkey, '{EX}nation/' || b.n_nationkey, 1 + 0.1 * (1 + (SELECT count(*) FROM customer WHERE c_nationkey = b.n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = b.n_nationkey))
      FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey),
    r AS (SELECT '{EX}nation/' || n AS section, node, round(score, 6) AS score, row_number() OVER (PARTITION BY n ORDER BY round(score, 9) DESC, node) AS rank FROM v)
    SELECT * FROM r WHERE rank <= 5"""
)
def section_frontiers(spark, d):
    _, edges, sections = _by_nation(spark, d)
    return context.frontiers(edges, sections, 5).select("section", "node", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(
    f"""WITH v AS (SELECT s_nationkey AS n, s_name AS subject, 'inNation' AS predicate, n_name AS object FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT n_nationkey, n_name, 'inRegion', r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
    r AS (SELECT '{EX}nation/' || n AS section, row_number() OVER (PARTITION BY n ORDER BY subject, predicate, object) AS place, subject, predicate, object FROM v)
    SELECT * FROM r WHERE place <= 4"""
)
def section_triples(spark, d):
    t = star_as_triples(spark, d, ["region", "nation", "supplier"]).filter(F.col("p") != T.SUBCLASS)
    own = table(spark, d, "supplier").select(node("nation", "s_nationkey").alias("section"), node("supplier", "s_suppkey").alias("node"))
    sections = own.unionByName(_by_nation(spark, d)[2])
    return context.section_triples(graph.edges_of(t), graph.labels_of(t), sections, 4).withColumn("place", F.col("place").cast("bigint"))


@query()
def section_growth(spark, d):
    """Every nation grown by up to 60 nodes, each claimed by one; the tests hold it against a plain loop."""
    _, edges, sections = _by_nation(spark, d)
    return context.grow(edges, sections, 60, 20)
