"""Files of rows with different keys, and a log of the queries that were run.

``write_csv``, ``write_json_lines`` and ``write_markdown`` take rows whose map
column ``values`` holds what each row has; their columns are the union of all
keys, in the order of their names, and what a row lacks is empty. Only the keys
pass through the driver: columns of one file.

``logged`` writes a query's result and then one row about it: name, hash of its
text, rows, nulls by column, start and seconds, or the error of one that failed.
Rows are counted by an observation while they are written, so nothing is read
twice, and a task that is run again counts once.
"""

from __future__ import annotations

import datetime
import hashlib
import time
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LOG = "query string, text_hash string, rows long, nulls map<string,long>, started timestamp, seconds double, path string, error string"


def keys_of(rows: DataFrame, values: str = "values") -> list[str]:
    """All keys of the maps, by name."""
    return sorted(r.key for r in rows.select(F.explode(F.map_keys(values)).alias("key")).distinct().collect())


def spread(rows: DataFrame, values: str = "values") -> DataFrame:
    """A column for each key; what a row lacks is an empty string."""
    return rows.select(*(F.coalesce(F.try_element_at(F.col(values), F.lit(key)).cast("string"), F.lit("")).alias(key) for key in keys_of(rows, values)))


def write_csv(rows: DataFrame, path: str, values: str = "values") -> None:
    spread(rows, values).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json_lines(rows: DataFrame, path: str, values: str = "values") -> None:
    """One object a line, with the keys that the row has."""
    rows.select(F.to_json(values).alias("value")).write.mode("overwrite").text(path)


def write_markdown(rows: DataFrame, path: str, values: str = "values") -> None:
    """A table in every file, headed by the keys; bars and line ends in cells are escaped."""
    table = spread(rows, values)
    cell = lambda c: F.regexp_replace(F.replace(F.col("`" + c.replace("`", "``") + "`"), F.lit("|"), F.lit("\\|")), r"\R", "<br>")
    line = lambda cells: "| " + " | ".join(cells) + " |"
    head = "\n".join([line(c.replace("|", "\\|") for c in table.columns), line("---" for _ in table.columns)])

    def with_head(batches):
        first = True
        for b in batches:
            if first and b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([head])], schema=b.schema)
                first = False
            yield b

    body = table.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in table.columns)), F.lit(" |")).alias("value"))
    body.mapInArrow(with_head, "value string").write.mode("overwrite").text(path)


def logged(name: str, text: str, run: Callable[[], DataFrame], path: str, log: str) -> DataFrame:
    """Write what ``run`` gives below ``path``, append a row to ``log``, and return the written rows.

    A query that fails is raised again after its row, which then holds the error and no count.
    """
    started, begin = datetime.datetime.now(datetime.timezone.utc), time.monotonic()
    counts: dict = {}
    error, df = None, None
    try:
        df = run()
        seen = Observation(f"rows-{uuid.uuid4().hex}")
        nulls = [F.count_if(F.col("`" + c.replace("`", "``") + "`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *nulls).write.mode("overwrite").parquet(path)
        counts = seen.get
    except Exception as e:
        error = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
        raise
    finally:
        spark = SparkSession.active()
        told = {c: counts[f"n{i}"] for i, c in enumerate(df.columns) if counts.get(f"n{i}")} if counts else {}
        row = (name, hashlib.sha256(text.encode()).hexdigest(), counts.get("rows"), told, started, round(time.monotonic() - begin, 3), path, error)
        spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(log)
    return spark.read.schema(df.schema).parquet(path)
