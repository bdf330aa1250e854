"""Streaming pieces: windows over events, as a batch and as a stream that reads all there is."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.checkpoints import scratch
from labelloom.registry import query, table
from labelloom.streaming import flows


@query("ST3", "SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def log_rotation(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy(F.window("ts", "15 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n")


@query("ST2 ST3", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def streamed_windows(spark: SparkSession, d: str) -> DataFrame:
    """The same counts through readStream, a watermark and a tumbling window."""
    events = flows.read(spark, f"{d}/events.parq*", table(spark, d, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = flows.tumbling(events, "ts", "1 day", "60 days", [])
    out = flows.to_memory(counts, f"windows_{uuid.uuid4().hex}", "complete", f"{scratch(spark)}/windows-{uuid.uuid4().hex}")
    return out.select(F.col("window.start").alias("start"), "n")


@query("", "SELECT user_id, CAST(max(event_id) AS BIGINT) AS sequence_number, CAST(count(DISTINCT event_id) AS BIGINT) AS n FROM events GROUP BY user_id")
def shard_positions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").dropDuplicates(["event_id"]).groupBy("user_id").agg(F.max("event_id").alias("sequence_number"), F.count("*").alias("n"))
