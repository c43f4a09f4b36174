"""Structured Streaming over the event log: each query runs over what there is and stops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.scratch import scratch


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The files of a table, a folder or one file, as a stream with UTC timestamps."""
    schema = spark.read.parquet(path).schema
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    folder, name = (path, "*.parquet") if whole else path.rsplit("/", 1)
    raw = spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", 16).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str, label: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream until its input is used up; the rows it wrote. A batch is written to a folder of
    its id, so a repeated batch replaces itself."""
    spark = stream.sparkSession
    out, shapes = scratch(spark, label), []

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch) if prepare else batch
        shapes.append(rows.schema)
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id:08d}")

    q = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", scratch(spark, f"{label}-state")).foreachBatch(write).start()
    q.awaitTermination()
    if not shapes:  # no file to read, no batch
        return spark.createDataFrame([], (prepare(stream) if prepare else stream).schema)
    return spark.read.schema(shapes[0]).parquet(f"{out}/batch=*")


def daily_completed(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts by UTC day and type of the days that the watermark has passed."""
    days = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    flat = days.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")
    return drain(flat, "append", "stream-daily").select("day", "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Bursts of each user: closed session windows with their number of events."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    flat = s.select("user_id", F.col("session_window.start").alias("start"), "n")
    return drain(flat, "append", "stream-sessions").select("user_id", "start", "n")


def totals(events: DataFrame, key: str = "user_id", late: str = "400 days") -> DataFrame:
    """Running totals: each batch adds its own sums, and a repeat of an event_id within `late` is dropped; the
    state forgets ids older than that."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    rows = drain(once, "append", "stream-totals", lambda b: b.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total")))
    return rows.groupBy(key).agg(F.sum("n").alias("n"), F.sum("total").cast("double").alias("total"))
