"""Streams over files, each of which ends when all that is there has been read (`availableNow`)."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from labelloom.sources.files import demux


def read(spark: SparkSession, path: str, schema, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def drained(query: StreamingQuery, seconds: int | None = None) -> bool:
    """Waits until the stream has read all there is, or the time is up; says whether it ended."""
    return query.awaitTermination(seconds) if seconds is not None else query.awaitTermination() is None


def tumbling(events: DataFrame, at: str, width: str, late: str, by: list[str]) -> DataFrame:
    """Counts of each window, final once the watermark has passed it."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n"))


def flush_log(lines: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends a detector log's records to a table for each kind; each batch's files bear its number, so a
    batch that is done again after a failure overwrites its own rows."""

    def flush(batch: DataFrame, number: int) -> None:
        batch.persist()
        for kind, rows in demux(batch).items():
            rows.write.mode("overwrite").parquet(os.path.join(folder, kind, f"batch={number}"))
        batch.unpersist()

    return lines.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_each(hits: DataFrame, key: str, at: str, late: str, ingest: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Hands on each hit once, however often it is polled within the watermark."""
    fresh = hits.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    return fresh.writeStream.foreachBatch(lambda batch, _: ingest(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def crawl_counts(seen: DataFrame, page: str) -> DataFrame:
    """Seen counts by page, kept as state over the whole stream (complete or update mode)."""
    return seen.groupBy(page).agg(F.count("*").alias("crawls"), F.size(F.collect_set("video_id")).cast("long").alias("videos"))


def to_memory(rows: DataFrame, name: str, mode: str, checkpoint: str | None = None) -> DataFrame:
    """Runs a stream into a table in memory; for tests and reports of bounded size."""
    writer = rows.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    query.awaitTermination()
    return rows.sparkSession.table(name)
