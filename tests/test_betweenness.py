import random

import pytest

from graphloom.operators import graph


def scores(df):
    return {r.node: round(r.betweenness, 6) for r in df.collect()}


@pytest.mark.parametrize("enough", [0, 12])
def test_folding_trees_changes_nothing(spark, enough):
    random.seed(4)
    core = [(f"c{i}", f"c{random.randrange(20)}") for i in range(20) for _ in range(2)]
    trees = [(f"t{i}", random.choice([f"c{random.randrange(20)}", f"t{random.randrange(i)}" if i else "c0"])) for i in range(60)]
    alone = [("a", "b"), ("b", "c"), ("x", "y"), *((f"s{i}", "hub") for i in range(15))]
    edges = spark.createDataFrame([(a, "p", b) for a, b in core + trees + alone], "src string, predicate string, dst string")
    want = scores(graph.betweenness(edges))
    assert want["hub"] == 15 * 14 / 2 and want["b"] == 1 and want["x"] == 0
    assert scores(graph.betweenness(edges, max_nodes=enough)) == want


def test_a_forest_needs_no_row_for_each_pair(spark, monkeypatch):
    monkeypatch.setattr(graph, "betweenness_by_frontiers", None)
    edges = spark.range(1500).selectExpr("concat('s', id) AS src", "'p' AS predicate", "concat('n', id % 5) AS dst")
    edges = edges.unionByName(spark.range(5).selectExpr("concat('n', id) AS src", "'p' AS predicate", "'r' AS dst"))
    got = scores(graph.betweenness(edges, max_nodes=50))
    assert len(got) == 1506 and got["s1"] == 0
    assert got["n1"] == 300 * 299 / 2 + 300 * 1205 and got["r"] == 10 * 301 * 301
