"""Streaming forms of the checks. Batch and stream share one expression, so a replay gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def failures_by_window(events: DataFrame, least: float, width: str = "1 hour", watermark: str | None = "2 hours") -> DataFrame:
    """(event_type, window_start, n, failed): rows, and rows below `least`, by tumbling window. `watermark` bounds the state of a stream."""
    rows = events.withWatermark("ts", watermark) if watermark else events
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") < least).alias("failed"))
    return out.select("event_type", F.col("w.start").alias("window_start"), "n", "failed")


def unique_events(events: DataFrame, key: str = "event_id", watermark: str = "2 hours") -> DataFrame:
    """A stream without repeats of a key that arrive within the watermark."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])


def incremental(spark: SparkSession, source: str, schema, process, target: str, checkpoint: str, max_files: int = 100) -> StreamingQuery:
    """New files of `source` through `process`, appended to `target` once each: a restart resumes where the checkpoint stands.

    A batch's rows go to a folder of its own number, overwritten if the batch is run again, so no row is paid for twice.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
