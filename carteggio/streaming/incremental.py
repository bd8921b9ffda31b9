"""Incremental forms with Structured Streaming: new files once, messages once, open threads with state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def read_folder(spark: SparkSession, folder: str, schema, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand on what is there in batches and stop; a second run starts where this one ended."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once(stream: DataFrame, key: str, time: str, late: str = "7 days") -> DataFrame:
    """Rows without those whose key was seen within the watermark; state older than that is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windows(stream: DataFrame, time: str, kind: str, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, end, kind, n, total) per tumbling or sliding window."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    counted = stream.withWatermark(time, late).groupBy(w, kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), kind, "n", "total")


def sessions(stream: DataFrame, time: str, user: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(start, end, user, n) per session: rows of a user no more than ``gap`` apart."""
    counted = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), user).agg(F.count("*").alias("n"))
    return counted.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), user, "n")


def open_threads(stream: DataFrame, time: str, idle: str = "365 days") -> DataFrame:
    """(thread_key, messages, last_id) of the threads every batch touches, by a built-in aggregation in update mode.

    Messages are counted per period of event time of length ``idle``; the state of a period is dropped once the newest
    time seen has passed its end. Rows without true key or time are left out.
    """
    keyed = stream.where(f"thread_key like 't-%' and {time} is not null").select("thread_key", "id", F.col(time).cast("timestamp").alias("_at"))
    counted = keyed.withWatermark("_at", "0 seconds").groupBy("thread_key", F.window("_at", idle)).agg(F.count("*").alias("messages"), F.max("id").alias("last_id"))
    return counted.select("thread_key", "messages", "last_id")
