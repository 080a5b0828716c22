"""Streams: refreshing the index as files come, and usage over event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lattica.functions.paths import language
from lattica.index import upsert
from lattica.sources.scan import indexable

BULK = 50


def file_events(spark: SparkSession, root: str, per_batch: int = 1000) -> DataFrame:
    """A stream of (path, language, hash, size, content) of files that appear or change below ``root``."""
    kind = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(kind).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).load(root)
    return indexable(raw).select("path", language(F.col("path")).alias("language"), F.sha2("content", 256).alias("hash"), F.col("length").alias("size"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"), "modificationTime")


def refresh(events: DataFrame, apply: Callable[[DataFrame, bool], None], checkpoint: str, every: str | None = "300 milliseconds") -> StreamingQuery:
    """Hand each micro-batch, the last version of each path, to ``apply(files, bulk)``; batches never overlap.

    ``every`` is how long changes are gathered; None reads what there is and stops."""

    def once(batch: DataFrame, _: int) -> None:
        last = batch.groupBy("path").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "path"]), "modificationTime").alias("f")).select("path", "f.*").persist()
        n = last.count()
        if n:
            apply(last.drop("modificationTime"), n > BULK)
        last.unpersist()

    writer = events.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def merged(old: DataFrame, batch: DataFrame) -> DataFrame:
    """A table of files after a batch."""
    return upsert(old, batch.select(*[c for c in old.columns if c in batch.columns]), ["path"])


def debounced(events: DataFrame, key: str = "path", gap: str = "300 milliseconds", late: str = "1 minute") -> DataFrame:
    """(key, first_at, last_at, n): bursts of events (key, ts): one row when ``gap`` has passed without another."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    bursts = timed.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return bursts.select(key, F.col("w.start").alias("first_at"), F.col("w.end").alias("last_at"), "n")


def trailing_usage(events: DataFrame, width: str = "7 days", slide: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, end, command, n): invocations (timestamp, command) per sliding window."""
    timed = events.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late)
    return timed.groupBy(F.window("timestamp", width, slide).alias("w"), "command").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "command", "n")


def closing(events: DataFrame, opened: str, closed: str, within: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(task_id, opened_at, closed_at): a stream-stream join of invocations (task_id, command, timestamp): an ``opened`` and a ``closed`` that follows in time."""
    timed = events.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late)
    a = timed.where(F.col("command") == opened).select("task_id", F.col("timestamp").alias("opened_at"))
    b = timed.where(F.col("command") == closed).select(F.col("task_id").alias("t"), F.col("timestamp").alias("closed_at"))
    return a.join(b, F.expr(f"task_id = t and closed_at >= opened_at and closed_at <= opened_at + interval {within}")).select("task_id", "opened_at", "closed_at")
