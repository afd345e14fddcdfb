"""Streaming extensions on the event table, drained, with batch SQL as oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.streaming import incremental as S


def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.drain(S.tumbling_counts(S.stream_table(spark, sf_dir, "events")), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.drain(S.session_counts(S.stream_table(spark, sf_dir, "events")), "complete")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def incremental_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drain(S.first_seen(S.stream_table(spark, sf_dir, "events"), ["event_id"])).select("event_id", "user_id", "event_type")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (tumbling_counts, session_counts, incremental_dedupe)}
ORACLES = {
    "tumbling_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "session_counts": """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS nw FROM events),
      s AS (SELECT user_id, ts, sum(nw) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e)
      SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, s""",
    "incremental_dedupe": "SELECT event_id, min(user_id) AS user_id, min(event_type) AS event_type FROM events GROUP BY 1",
}
