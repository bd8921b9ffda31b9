"""Streaming operators run to the end of what is there, so their tables can be checked like any other."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carteggio.session import shared_dir
from carteggio.sources.tables import table
from carteggio.streaming import incremental

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _stream(spark: SparkSession, root: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """A table of a data directory as a stream: one file, or a folder of part files."""
    schema = table(spark, root, name).schema
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{root}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(root)


def _drain(spark: SparkSession, df: DataFrame, mode: str) -> DataFrame:
    """Everything a stream gives, written batch by batch to the shared folder (exactly once per batch) and read back.

    In mode ``complete`` every batch is the whole result, so the last one is read.
    """
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/out/batch={n}")
    df.writeStream.outputMode(mode).foreachBatch(out).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    done = spark.read.parquet(f"{base}/out")
    if mode == "complete":
        done = done.where(F.col("batch") == done.agg(F.max("batch")).first()[0])
    return done.drop("batch")


@query("""select time_bucket(interval '6 hours', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2""")
def stream_windows(spark, root):
    events = _stream(spark, root, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    done = _drain(spark, incremental.windows(events, "ts", "event_type", "6 hours"), "complete")
    return done.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""select user_id, min(ts) as start, count(*) as n from (select *, sum(coalesce((ts - p > interval '30 minutes')::int, 1)) over (partition by user_id order by ts, event_id rows unbounded preceding) as s
 from (select *, lag(ts) over (partition by user_id order by ts, event_id) as p from events)) group by user_id, s""")
def stream_sessions(spark, root):
    events = _stream(spark, root, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    done = _drain(spark, incremental.sessions(events, "ts", "user_id"), "complete")
    return done.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("select thread_key, count(*) as messages, max(id) as last_id from emails where thread_key like 't-%' group by 1")
def stream_open_threads(spark, root):
    done = _drain(spark, incremental.open_threads(_stream(spark, root, "emails").select("thread_key", "id", "imported_at"), "imported_at", "36500 days"), "update")
    return done.groupBy("thread_key").agg(F.max("messages").alias("messages"), F.max("last_id").alias("last_id"))
