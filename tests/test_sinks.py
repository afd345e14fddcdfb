import json

import pytest

from graphloom.sources import sinks


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(1, {"b": "x|y", "a": "1"}), (2, {"c": 'say "hi"\nnow'}), (3, {})], "id int, values map<string,string>").coalesce(1)


def test_columns_are_the_union_of_keys(spark, rows, tmp_path):
    sinks.write_csv(rows, f"file://{tmp_path}/csv")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"file://{tmp_path}/csv")
    assert back.columns == ["a", "b", "c"]
    assert sorted(tuple(v or "" for v in r) for r in back.collect()) == [("", "", ""), ("", "", 'say "hi"\nnow'), ("1", "x|y", "")]
    sinks.write_json_lines(rows, f"file://{tmp_path}/json")
    assert [json.loads(r.value) for r in spark.read.text(f"file://{tmp_path}/json").collect()] == [{"b": "x|y", "a": "1"}, {"c": 'say "hi"\nnow'}, {}]
    sinks.write_markdown(rows, f"file://{tmp_path}/md")
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/md").collect()] == ["| a | b | c |", "| --- | --- | --- |", "| 1 | x\\|y |  |", '|  |  | say "hi"<br>now |', "|  |  |  |"]


def test_the_log_counts_what_was_written(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    df = spark.range(1000).selectExpr("id", "nullif(id % 4, 0) AS `a.b`").repartition(7)
    out = sinks.logged("numbers", "SELECT ...", lambda: df, f"file://{tmp_path}/out", log)
    assert out.count() == 1000
    with pytest.raises(Exception, match="nowhere"):
        sinks.logged("bad", "x", lambda: spark.read.parquet("file:///nowhere/at/all"), f"file://{tmp_path}/none", log)
    told = {r["query"]: r for r in spark.read.parquet(log).collect()}
    assert (told["numbers"].rows, told["numbers"].nulls, told["numbers"].error) == (1000, {"a.b": 250}, None)
    assert told["bad"].rows is None and "nowhere" in told["bad"].error and told["numbers"].seconds > 0
