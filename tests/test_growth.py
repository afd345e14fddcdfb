"""What plans of graph operators may not hold or move at size, and that results stay."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import evaluate, graph, profile, rules, validate, vectors
from graphloom.terms import EX, RDFS, TYPE

TRIPLE = "s string, p string, o string, s_kind string, o_kind string, o_dt string, o_lang string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def triples(spark):
    random.seed(5)
    rows = [(f"n{i}", TYPE, EX + random.choice("AB"), "iri", "iri", "", "") for i in range(60)]
    rows += [(f"n{random.randrange(90)}", EX + random.choice("pqr"), f"n{random.randrange(120)}", random.choice(["iri", "bnode"]), "iri", "", "") for _ in range(300)]
    rows += [(f"n{i % 70}", EX + "v", str(i % 9), "iri", "lit", random.choice(["", "x"]), "") for i in range(200)]
    return rows


def test_label_propagation_votes_by_numbers(spark):
    random.seed(7)
    pairs = [(f"a{random.randrange(40)}", f"b{random.randrange(25)}") for _ in range(300)] + [("self", "self"), ("Z", "a1")]
    votes = defaultdict(Counter)
    for a, b in pairs:
        if a != b:
            votes[a][b] += 1
            votes[b][a] += 1
    label = {v: v for v in votes}
    for _ in range(3):
        count = {v: Counter() for v in votes}
        for v, near in votes.items():
            for u, n in near.items():
                count[v][label[u]] += n
        label = {v: min(c, key=lambda x: (-c[x], x)) for v, c in count.items()}
    df = graph.label_propagation(spark.createDataFrame(pairs, "src string, dst string").repartition(3), 3)
    assert {r.node: r.community for r in df.collect()} == label


def test_health_counts_repeats_and_nodes(spark):
    for rows in (triples(spark), list({r[:3] + r[4:]: r for r in triples(spark)}.values()), []):
        got = profile.health(spark.createDataFrame(rows, TRIPLE)).first().asDict()
        subjects, typed = {r[0] for r in rows}, {r[0] for r in rows if r[1] == TYPE}
        used = {r[2] for r in rows if r[4] != "lit" and r[1] != TYPE}
        assert got == {
            "triples": len(rows), "untyped_numbers": sum(r[4] == "lit" and r[5] == "" for r in rows), "with_bnodes": sum("bnode" in (r[3], r[4]) for r in rows),
            "untyped_nodes": len(subjects - typed), "repeated": len(rows) - len({(r[0], r[1], r[2], *r[4:]) for r in rows}), "dangling": len(used - subjects),
        }


def test_class_predicates_and_functional_values_are_dealt_once(spark):
    rows = triples(spark)
    t = spark.createDataFrame(rows, TRIPLE)
    df = profile.class_predicate_counts(t)
    classes = {r[0]: r[2] for r in rows if r[1] == TYPE}
    assert {(r.cls, r.p): r.n for r in df.collect()} == Counter((classes[r[0]], r[1]) for r in rows if r[1] != TYPE and r[0] in classes)
    bad = validate.functional_violation(t, [EX + "v", EX + "p"])
    values = defaultdict(set)
    for r in rows:
        if r[1] in (EX + "v", EX + "p"):
            values[r[0], r[1]].add((r[2], *r[4:]))
    assert {(r.s, r.p): int(r.detail) for r in bad.collect()} == {k: len(v) for k, v in values.items() if len(v) > 1}
    assert plan(bad).count("Exchange hashpartitioning") == 1


def test_repeat_streak_stays_in_its_row(spark):
    texts = {1: "One two three four five. One two three four five! Other words here. One two three four fivE. One two three four five. One two three four five.", 2: "aa. aa", 3: "", 4: "x. y. z?", 5: None, 6: "Only one"}
    docs = spark.createDataFrame([*texts.items(), (2, "ab")], "doc_id long, text string")
    df = evaluate.repeat_streak(docs, "doc_id", "text", 0.8)
    assert {r.doc_id: r.streak for r in df.collect()} == {1: 3, 2: 1, 4: 3, 6: 1}
    assert "Window" not in plan(df)


def test_pairs_count_repeated_tokens(spark):
    lines = ["the cat and the dog and the cow", "the the the", "a dog", "", "and the end", "dog dog cow", "the cat and the dog and the cow"]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "g int, pos long, text string")
    s = evaluate.Settings()
    both = evaluate.scored(evaluate.dealt(rows, "g", "q", s).join(evaluate.dealt(rows, "g", "c", s), "g"))
    assert "q_reps" in both.columns  # pairs need no token lists
    words = lambda c: F.transform(X.tokens(F.col(c)), lambda x: F.xxhash64(x))
    got = both.select("tfidf", X.pair_tfidf_cosine(words("q_text"), words("c_text")).alias("want")).collect()
    assert len(got) == 49 and all(r.tfidf == r.want for r in got) and len({r.want for r in got}) > 8


def test_rules_deal_triples_by_subject_once(spark):
    t = triples(spark)
    data = spark.createDataFrame(t + t[:50], TRIPLE)
    schema = spark.createDataFrame([(EX + "p", RDFS + "domain", EX + "A", "iri", "iri", "", ""), (EX + "q", RDFS + "range", EX + "B", "iri", "iri", "", "")], TRIPLE)
    df = rules.check(data, schema)
    assert not re.search(r"hashpartitioning\(s#\d+, p#", plan(df))
    cls = defaultdict(set)
    for r in t:
        if r[1] == TYPE:
            cls[r[0]].add(r[2])
    want = Counter()
    for s, p, o, _, ok, *_ in {r for r in t if r[1] != TYPE}:
        want[(p, "domain_unknown") if p != EX + "p" else (p, "subject_untyped") if not cls[s] else (p, "" if EX + "A" in cls[s] else "domain_mismatch")] += 1
        about_o = "range_unknown" if p != EX + "q" else "blank_node_object" if ok == "bnode" else "object_untyped" if not cls[o] else "" if EX + "B" in cls[o] else "range_mismatch_iri"
        want[p, about_o] += 1
    assert Counter((r.property, r.code) for r in df.collect()) == Counter({k: n for k, n in want.items() if k[1]})


class _Local:
    """A frame that hands its Arrow function back."""

    def __getattr__(self, _):
        return self

    def broadcast(self, value):
        return SimpleNamespace(value=value)

    def mapInArrow(self, run, _):
        return run


def test_cells_of_a_batch_are_found_in_small_steps():
    rng = np.random.default_rng(3)
    centres, m = rng.normal(size=(4096, 16)), rng.normal(size=(3000, 16))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(m))), pa.array(m.tolist(), pa.list_(pa.float64()))], names=["id", "v"])
    for count in (3, 200):
        run = vectors._with_cells(_Local(), centres, "l2", count, rank=True)
        start = pa.total_allocated_bytes()
        tracemalloc.start()
        found, most = [], 0
        for b in run([batch]):
            most = max(most, pa.total_allocated_bytes() - start)
            found.append(np.asarray(b.column(2)).copy())
            del b
        most += tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert (np.concatenate(found) == vectors.order_of_cells(m, centres, "l2")[:, :count].ravel()).all()
        assert most < 80 << 20


def test_health_of_tables_shuffles_keys_and_values(spark, tmp_path):
    from datetime import datetime

    from graphloom.queries import kg

    day = lambda d, h=0: datetime(2020, 1, d, h)
    tables = {
        "region": ("r_regionkey int, r_name string", [(0, "12,3"), (1, None)]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "N", 0), (1, "M", 7), (0, "N", 1)]),
        "customer": ("c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", [(1, "x", 0, 1.5, "S"), (1, "x", 1, 1.5, None), (2, "77", 9, None, "S"), (None, "q", 0, 2.0, "S"), (None, "q", 0, 3.0, "T")]),
        "supplier": ("s_suppkey long, s_name string, s_nationkey int, s_acctbal double", [(1, "s", 9, 0.5)]),
        "part": ("p_partkey long, p_name string, p_brand string, p_type string, p_size int", [(1, "p", "b", "t", 5)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string", [(1, 1, "O", 1.0, day(1), "1"), (1, 5, "O", 2.0, day(1, 5), "2"), (3, None, None, None, None, None)]),
        "lineitem": (
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string",
            [(1, 1, 1, 1, 2.0, "N"), (1, 1, 2, 1, 2.0, "A"), (1, 4, 2, 1, 3.0, "N"), (8, None, 1, 1, None, None), (None, 1, 1, 5, 1.0, "N"), (5, 1, 1, None, 1.0, "N"), (1, 1, 1, 2, 2.0, "N")],
        ),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    got = kg.health_summary(spark, str(tmp_path))
    want = profile.health(kg.star_as_triples(spark, str(tmp_path), kg.EVERY).filter(F.col("p") != kg.T.SUBCLASS))
    assert got.columns == want.columns and got.first() == want.first()
    assert got.first()["dangling"] == 7 and got.first()["untyped_numbers"] == 4 and got.first()["repeated"] > 15
    assert "hashpartitioning(l_orderkey" in plan(got) and "Generate explode" not in plan(got)
