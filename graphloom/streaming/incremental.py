"""Structured Streaming extensions: incremental triples, windowed counts, sessions.

These go beyond batch semantics by design: late rows are bounded by a watermark,
and every query runs until its input is used up (``availableNow``), writing to a
folder with a checkpoint, so it can be stopped and resumed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.lineage import shared_dir


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream; its schema is read from the table once. Event times need a time zone: the session's."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque*")
    local = [f.name for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return stream.withColumns({c: stream[c].cast("timestamp") for c in local})


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and read back what it wrote."""
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/graphloom/stream-{uuid.uuid4().hex}"
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{folder}/out")
    else:  # state as of the last batch replaces what was written before
        writer = stream.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/out"))
    query = writer.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events and total value per window and type."""
    windowed = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return windowed.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Events per user and session; a session ends after a gap without events."""
    sessions = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return sessions.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Each key's row once, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
