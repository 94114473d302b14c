"""Structured Streaming: payload ingestion, session logs and windowed decision counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.payload import read_payload
from ..sources.store import Store


def ingest_payloads(spark: SparkSession, folder: str, store: Store, checkpoint: str) -> StreamingQuery:
    """Write each payload file that arrives in a folder to the store, in order of its path; the checkpoint makes it once each."""

    def write(batch: DataFrame, _: int) -> None:
        for row in batch.orderBy("path").toLocalIterator():
            nodes, edges, metadata = read_payload(spark, row["value"])
            store.write(nodes, edges, metadata)

    files = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", 100).load(folder).withColumn("path", F.col("_metadata.file_path"))
    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _timed(events: DataFrame) -> DataFrame:
    """Watermarks need a time stamp with a zone; the tables' are in UTC without one."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def distinct_events(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Session events without repeats that arrive within the delay; state older than it is dropped."""
    return _timed(events).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def decision_counts(events: DataFrame, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Decisions by outcome in tumbling windows; works on a stream (append mode) and on a table."""
    counted = _timed(events).withWatermark("ts", delay).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "value")
