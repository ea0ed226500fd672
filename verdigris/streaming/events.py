"""Streams of observation revisions and events: windows with watermarks, and the latest revision of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files: str = "events.parquet", per_trigger: int = 1) -> DataFrame:
    """The events under a folder, as one file of that name or as a folder of part files."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).parquet(f"{folder}/{files}*")


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and value sums (in cents) by window and type; with `late`, a watermark bounds the state of a stream."""
    if late:
        events = events.withWatermark("ts", late)
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "cents")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    if late:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def latest_by_key(events: DataFrame) -> DataFrame:
    """The value of the largest event of each (user, type): state is one row for each key."""
    return events.groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("event_id"))


def run_available(stream: DataFrame, path: str, mode: str = "update") -> None:
    """Process what is there and stop; each batch is written under its number, so a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/rows/batch={number:08d}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()


def stream_latest(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """The latest revisions after all batches: updates of a key in later batches win."""
    run_available(latest_by_key(read_events(spark, folder)), path)
    rows = spark.read.schema("user_id long, event_type string, value double, event_id long").parquet(f"{path}/rows/*")
    return rows.groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("event_id"))


def deduplicated(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """The first event of each key within the watermark: repeated deliveries of a revision are dropped, state is bounded."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def progress(events: DataFrame, batch: str, decided: str) -> DataFrame:
    """Running size and decided count of each batch; state is one row a batch."""
    return events.groupBy(batch).agg(F.count(F.lit(1)).alias("group_count"), F.count_if(F.expr(decided)).alias("decided_count"))


def stream_progress(spark: SparkSession, folder: str, path: str, batch: str, decided: str) -> DataFrame:
    """Batch progress after all input: the last update of each batch."""
    run_available(progress(read_events(spark, folder), batch, decided), path)
    rows = spark.read.parquet(f"{path}/rows/*")
    last = rows.groupBy(batch).agg(F.max_by(F.struct("group_count", "decided_count"), "batch").alias("r"))
    return last.select(batch, "r.group_count", "r.decided_count", F.when(F.col("r.group_count") == F.col("r.decided_count"), "closed").otherwise("open").alias("status"))


def stream_deduplicated(spark: SparkSession, folder: str, path: str, keys: list[str], late: str) -> DataFrame:
    """Events without repeated deliveries, appended batch by batch."""
    run_available(deduplicated(read_events(spark, folder), keys, late), path, "append")
    return spark.read.parquet(f"{path}/rows/*").drop("batch")
