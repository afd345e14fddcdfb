"""Sums in the order of the SQL's ``list_distinct``."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions.distinct_order import list_distinct
from graphloom.operators import evaluate
from graphloom.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck():
    import duckdb

    return duckdb.connect()


def test_list_distinct_has_the_order_of_the_sql(duck):
    draw = random.Random(1)
    for n in [0, 1, 2, 12, 13, 14, 15, 29, 30, 60, 128, 600, 6000] + [draw.randrange(80) for _ in range(100)]:
        words = ["".join(draw.choice("abcdefghij'019") for _ in range(draw.randrange(1, 28))) for _ in range(n)] + ["a", "b", "a"][: n % 4]
        assert list_distinct(words) == duck.execute("SELECT list_distinct(?::VARCHAR[])", [words]).fetchone()[0]


def test_near_misses_of_one_score_are_ranked_as_in_the_sql(spark, duck, tmp_path):
    # 120 pairs with the same counts and other words: one score on paper, several in the last digits of the SQL
    draw, rows = random.Random(2), []
    word = lambda: "".join(draw.choice("bcdfghjklmnpqrstvwxz") for _ in range(7))
    for i in range(120):
        line = [shared := word()] * 3 + [word() for _ in range(8)]
        draw.shuffle(line)
        rows += [(i, 0, "user", f"{shared} {word()}"), (i, 1, "assistant", " ".join(line))]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    duck.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = duck.execute(ORACLES["near_miss_topk"]).fetchall()
    assert len(want) == 50 and [r[0] for r in want] != list(range(50))  # the last digits decide
    assert [tuple(r) for r in QUERIES["near_miss_topk"](spark, str(tmp_path)).collect()] == want


def test_only_what_can_be_among_the_first_is_summed_again(spark):
    rows = [(i, i, "a b", "a c", 0.0, 0.0, 0.0, i / 100, 0.2) for i in range(100)]
    matched = spark.createDataFrame(rows, "conv_id long, pos long, text string, c_text string, names double, nums double, years double, tfidf double, char3 double").coalesce(1)
    out = evaluate.to_the_last_digit(matched, 0.2, 0.35, 1000)
    assert out.columns == matched.columns and sorted(r.pos for r in out.collect()) == list(range(36))  # the last is 0.35 less the slack
    assert evaluate.to_the_last_digit(matched.withColumn("text", F.lit(None).cast("string")), 0.2, 0.35, 1).filter("tfidf <> 0").count() == 0
    assert evaluate.to_the_last_digit(matched.filter("pos > 90"), 0.2, 0.35, 50).count() == 0
