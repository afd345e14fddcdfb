"""Graph-pattern queries over the star schema as triples, with relational SQL as their independent oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.compiler import Compiler
from graphloom.plans.parser import parse
from graphloom.sources.star import NAME, star_as_triples
from graphloom.terms import EX, RDFS, SCHEMA, TYPE

PREFIXES = {"ex": EX, "schema": SCHEMA, "n": EX + "nation/", "r": EX + "region/"}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def graph_query(name: str, tables: list[str], text: str, oracle: str, casts: dict[str, str] | None = None) -> None:
    """Register a query; ``casts`` names the SQL types of columns that are not strings."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = Compiler(star_as_triples(spark, sf_dir, tables)).compile(parse(text, PREFIXES))
        for c, kind in (casts or {}).items():
            df = df.withColumn(c, F.round(F.col(c).cast("double"), 4) if kind == "double" else F.col(c).cast(kind))
        return df

    QUERIES[name], ORACLES[name] = run, oracle


graph_query(
    "bgp_star_join", ["part"],
    "SELECT ?name ?brand ?size WHERE { ?p a ex:Part ; schema:name ?name ; ex:brand ?brand ; ex:size ?size }",
    "SELECT p_name AS name, p_brand AS brand, CAST(p_size AS BIGINT) AS size FROM part",
    {"size": "bigint"},
)
graph_query(
    "bgp_chain_join", ["region", "nation", "customer", "orders"],
    "SELECT ?order ?region WHERE { ?order ex:placedBy ?c . ?c ex:inNation ?n . ?n ex:inRegion ?r . ?r schema:name ?region }",
    """SELECT 'http://example.org/orders/' || o_orderkey AS "order", r_name AS region FROM orders
       JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
graph_query(
    "which_parts_ordered", ["nation", "customer", "orders", "lineitem", "part"],
    """SELECT ?customer (GROUP_CONCAT(DISTINCT ?part; separator=", ") AS ?parts) WHERE {
         ?order ex:placedBy ?c . ?c schema:name ?customer . ?line ex:ofOrder ?order ; ex:item ?p . ?p schema:name ?part } GROUP BY ?customer""",
    """SELECT c_name AS customer, string_agg(DISTINCT p_name, ', ' ORDER BY p_name) AS parts FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY c_name""",
)
graph_query(
    "optional_join", ["customer", "orders"],
    "SELECT ?name ?order WHERE { ?c a ex:Customer ; schema:name ?name OPTIONAL { ?order ex:placedBy ?c ; ex:priority '1-URGENT' } }",
    """SELECT c_name AS name, CASE WHEN o_orderkey IS NOT NULL THEN 'http://example.org/orders/' || o_orderkey END AS "order"
       FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT'""",
)
graph_query(
    "optional_group_nested", ["nation", "supplier", "customer"],
    """SELECT ?nation ?supplier ?rich WHERE { ?n a ex:Nation ; schema:name ?nation
         OPTIONAL { ?s a ex:Supplier ; ex:inNation ?n ; schema:name ?supplier OPTIONAL { ?s ex:balance ?rich FILTER(?rich > 5000) } } }""",
    """SELECT n_name AS nation, s_name AS supplier, CASE WHEN s_acctbal > 5000 THEN round(s_acctbal, 4) END AS rich
       FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey""",
    {"rich": "double"},
)
graph_query(
    "optional_rebind", ["customer", "orders", "nation"],
    """SELECT ?c ?tag WHERE { ?c a ex:Customer
         OPTIONAL { ?c ex:segment ?tag FILTER(?tag = 'BUILDING') } OPTIONAL { ?c ex:inNation ?n . ?n schema:name ?tag } }""",
    """SELECT 'http://example.org/customer/' || c_custkey AS c, CASE WHEN c_mktsegment = 'BUILDING' THEN 'BUILDING' ELSE n_name END AS tag
       FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
graph_query(
    "union_join", ["nation", "supplier", "customer"],
    "SELECT ?name ?nation WHERE { { ?x a ex:Supplier } UNION { ?x a ex:Customer } ?x schema:name ?name ; ex:inNation ?n . ?n schema:name ?nation }",
    """SELECT s_name AS name, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey
       UNION ALL SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
graph_query(
    "not_exists", ["customer", "orders"],
    "SELECT ?name WHERE { ?c a ex:Customer ; schema:name ?name FILTER NOT EXISTS { ?o ex:placedBy ?c ; ex:status 'F' } }",
    "SELECT c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
)
graph_query(
    "exists_semi", ["customer", "orders"],
    "SELECT ?name WHERE { ?c a ex:Customer ; schema:name ?name FILTER EXISTS { ?o ex:placedBy ?c ; ex:totalPrice ?t FILTER(?t > 300000) } }",
    "SELECT c_name AS name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
)
graph_query(
    "minus_shared", ["supplier", "nation"],
    "SELECT ?s WHERE { ?s a ex:Supplier ; ex:inNation ?n MINUS { ?n ex:inRegion r:1 } }",
    """SELECT 'http://example.org/supplier/' || s_suppkey AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey IS DISTINCT FROM 1""",
)
graph_query(
    "minus_disjoint", ["region"],
    "SELECT ?name WHERE { ?r a ex:Region ; schema:name ?name MINUS { ?a ex:nothing ?b } }",
    "SELECT r_name AS name FROM region",
)
graph_query(
    "values_tuple", ["orders"],
    "SELECT ?order ?status ?priority WHERE { VALUES (?status ?priority) { ('F' '1-URGENT') ('O' '2-HIGH') (UNDEF '5-LOW') } ?order ex:status ?status ; ex:priority ?priority }",
    """SELECT 'http://example.org/orders/' || o_orderkey AS "order", o_orderstatus AS status, o_orderpriority AS priority FROM orders
       WHERE (o_orderstatus, o_orderpriority) IN (('F', '1-URGENT'), ('O', '2-HIGH')) OR o_orderpriority = '5-LOW'""",
)
graph_query(
    "path_alternation", ["lineitem"],
    "SELECT ?line ?thing WHERE { ?line ex:item|ex:suppliedBy ?thing }",
    """SELECT 'http://example.org/lineitem/' || l_orderkey || '-' || l_linenumber AS line, 'http://example.org/part/' || l_partkey AS thing FROM lineitem
       UNION ALL SELECT 'http://example.org/lineitem/' || l_orderkey || '-' || l_linenumber, 'http://example.org/supplier/' || l_suppkey FROM lineitem""",
)
graph_query(
    "path_sequence_inverse", ["nation", "customer", "orders"],
    "SELECT ?nation (COUNT(?o) AS ?orders) WHERE { ?n a ex:Nation ; schema:name ?nation ; ^ex:inNation/^ex:placedBy ?o } GROUP BY ?nation",
    "SELECT n_name AS nation, count(*) AS orders FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    {"orders": "bigint"},
)
graph_query(
    "path_star_closure", ["region", "nation", "customer", "supplier"],
    "SELECT ?class (COUNT(DISTINCT ?x) AS ?members) WHERE { ?x a/rdfs:subClassOf* ?class } GROUP BY ?class",
    """WITH RECURSIVE up(a, b) AS (SELECT * FROM (VALUES ('Customer','Party'),('Supplier','Party'),('Party','Agent'),('Region','Place'),('Nation','Place')) t(a, b)
         UNION SELECT up.a, t.b FROM up JOIN (VALUES ('Customer','Party'),('Supplier','Party'),('Party','Agent'),('Region','Place'),('Nation','Place')) t(a, b) ON up.b = t.a),
       typed AS (SELECT 'Customer' AS c, c_custkey AS k FROM customer UNION ALL SELECT 'Supplier', s_suppkey FROM supplier UNION ALL SELECT 'Region', r_regionkey FROM region UNION ALL SELECT 'Nation', n_nationkey FROM nation),
       all_types AS (SELECT c AS class, c, k FROM typed UNION SELECT b, c, k FROM typed JOIN up ON up.a = typed.c)
       SELECT 'http://example.org/' || class AS class, count(DISTINCT c || k) AS members FROM all_types GROUP BY class""",
    {"members": "bigint"},
)
graph_query(
    "path_plus_containment", ["region", "nation", "supplier"],
    "SELECT ?s ?place WHERE { ?s a ex:Supplier ; (ex:inNation|ex:inRegion)+ ?place }",
    """SELECT 'http://example.org/supplier/' || s_suppkey AS s, 'http://example.org/nation/' || s_nationkey AS place FROM supplier
       UNION ALL SELECT 'http://example.org/supplier/' || s_suppkey, 'http://example.org/region/' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
graph_query(
    "cartesian", ["region", "nation"],
    "SELECT ?a ?b WHERE { ?x a ex:Region ; schema:name ?a . ?y a ex:Nation ; schema:name ?b }",
    "SELECT r_name AS a, n_name AS b FROM region CROSS JOIN nation",
)
graph_query(
    "group_concat_distinct", ["nation", "customer"],
    """SELECT ?nation (GROUP_CONCAT(DISTINCT ?segment; separator=", ") AS ?segments) (COUNT(?c) AS ?customers) WHERE {
         ?c a ex:Customer ; ex:segment ?segment ; ex:inNation ?n . ?n schema:name ?nation } GROUP BY ?nation""",
    """SELECT n_name AS nation, string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) AS segments, count(*) AS customers
       FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
    {"customers": "bigint"},
)
graph_query(
    "group_concat_empty", ["region"],
    'SELECT (GROUP_CONCAT(?name; separator=", ") AS ?names) (COUNT(*) AS ?n) WHERE { ?r a ex:Nothing ; schema:name ?name }',
    "SELECT '' AS names, CAST(0 AS BIGINT) AS n",
    {"n": "bigint"},
)
graph_query(
    "sum_group", ["nation", "customer", "orders"],
    "SELECT ?nation (SUM(?price) AS ?total) (AVG(?price) AS ?mean) WHERE { ?o ex:placedBy ?c ; ex:totalPrice ?price . ?c ex:inNation ?n . ?n schema:name ?nation } GROUP BY ?nation",
    "SELECT n_name AS nation, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 2) AS mean FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
)
graph_query(
    "sample_min_max", ["nation", "supplier"],
    "SELECT ?nation (SAMPLE(?name) AS ?any) (MIN(?b) AS ?low) (MAX(?b) AS ?high) WHERE { ?s a ex:Supplier ; schema:name ?name ; ex:balance ?b ; ex:inNation ?n . ?n schema:name ?nation } GROUP BY ?nation HAVING(COUNT(?s) > 1)",
    """SELECT n_name AS nation, min(s_name) AS "any", round(min(s_acctbal), 4) AS low, round(max(s_acctbal), 4) AS high FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 HAVING count(*) > 1""",
    {"low": "double", "high": "double"},
)
graph_query(
    "order_limit", ["orders"],
    "SELECT ?o ?price WHERE { ?o ex:totalPrice ?price } ORDER BY DESC(?price) ?o ?nothing LIMIT 25",
    """SELECT 'http://example.org/orders/' || o_orderkey AS o, round(o_totalprice, 4) AS price FROM orders ORDER BY o_totalprice DESC, 1 LIMIT 25""",
    {"price": "double"},
)
graph_query(
    "distinct_projection", ["part"],
    "SELECT DISTINCT ?brand ?size WHERE { ?p ex:brand ?brand ; ex:size ?size }",
    "SELECT DISTINCT p_brand AS brand, CAST(p_size AS BIGINT) AS size FROM part",
    {"size": "bigint"},
)
graph_query(
    "if_date_sentence", ["orders"],
    """SELECT ?o ?sentence WHERE { ?o ex:orderDate ?d ; ex:status ?s
         BIND(IF(YEAR(xsd:date(?d)) < 1995, "early", "late") AS ?when) BIND(CONCAT(STRAFTER(STR(?o), "orders/"), " was ", ?when, " with ", LCASE(?s), STRAFTER(?s, "#")) AS ?sentence) }""",
    """SELECT 'http://example.org/orders/' || o_orderkey AS o, o_orderkey || ' was ' || CASE WHEN year(o_orderdate) < 1995 THEN 'early' ELSE 'late' END || ' with ' || lower(o_orderstatus) AS sentence FROM orders""",
)
graph_query(
    "string_filters", ["part"],
    """SELECT ?name WHERE { ?p schema:name ?name ; ex:partType ?t ; ex:brand ?b FILTER(STRSTARTS(LCASE(STR(?t)), "promo") || CONTAINS(?name, "1") && !STRENDS(?b, "3")) FILTER(?b != "Brand#11") }""",
    "SELECT p_name AS name FROM part WHERE (lower(p_type) LIKE 'promo%' OR (contains(p_name, '1') AND NOT suffix(p_brand, '3'))) AND p_brand <> 'Brand#11'",
)
graph_query(
    "predicate_variable_in", ["customer"],
    "SELECT ?p (COUNT(*) AS ?n) WHERE { ?c ?p ?o FILTER(?p IN (ex:segment, ex:inNation, schema:name)) } GROUP BY ?p",
    f"""SELECT '{EX}segment' AS p, count(c_mktsegment) AS n FROM customer UNION ALL SELECT '{EX}inNation', count(c_nationkey) FROM customer UNION ALL SELECT '{NAME}', count(c_name) FROM customer""",
    {"n": "bigint"},
)
graph_query(
    "bind_constant_coalesce", ["nation", "supplier"],
    """SELECT ?name ?label WHERE { BIND(n:3 AS ?nation) ?s ex:inNation ?nation ; schema:name ?name OPTIONAL { ?s ex:nickname ?nick } BIND(COALESCE(?nick, ?name, STRAFTER(STR(?s), "#")) AS ?label) }""",
    "SELECT s_name AS name, s_name AS label FROM supplier WHERE s_nationkey = 3",
)
graph_query(
    "ask_any", ["nation"],
    "ASK { ?n schema:name 'FRANCE' }",
    "SELECT count(*) > 0 AS answer FROM nation WHERE n_name = 'FRANCE'",
)
_sum = QUERIES["sum_group"]
QUERIES["sum_group"] = lambda spark, d: _sum(spark, d).withColumns({c: F.round(F.col(c), 2) for c in ("total", "mean")})
__all__ = ["ORACLES", "QUERIES", "RDFS", "TYPE"]
