"""Structured Streaming: the inbox monitor and the running scoreboard of a growing log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.sources.deltas import latest, read_deltas, write_delta

NO_NEWS = "SIN_NOVEDADES"


def inbox_monitor(mail: DataFrame, lookback: str = "10 minutes", every: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """(window, sender, n, subjects): non-deleted items of mail(ts, sender, subject, deleted) by sender in
    sliding windows. On a stream the watermark bounds the state to the open windows."""
    items = mail.where("NOT deleted")
    if mail.isStreaming:
        items = items.withWatermark("ts", late)
    w = F.window("ts", lookback, every)
    return items.groupBy(w.alias("window"), "sender").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("subject")).alias("subjects"))


def quiet_intervals(events: DataFrame, ts: str, step: str, width: int) -> DataFrame:
    """(start, n, state) for every interval of `width` seconds between the first and the last event;
    state is SIN_NOVEDADES for intervals without events. The calendar is a sequence in one row."""
    sec = F.floor(F.unix_timestamp(ts) / width) * width
    counts = events.groupBy(sec.alias("s")).agg(F.count("*").alias("n"))
    span = counts.agg(F.min("s").alias("a"), F.max("s").alias("b")).where("a IS NOT NULL")
    calendar = span.select(F.explode(F.sequence("a", "b", F.lit(width))).alias("s"))
    out = calendar.join(counts, "s", "left")
    return out.select(F.timestamp_seconds("s").alias("start"), F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), NO_NEWS).otherwise("NOVEDADES").alias("state"))


def report_batches(stream: DataFrame, sink, trigger: dict | None = None, checkpoint: str | None = None):
    """Starts a query that gives each micro-batch to sink(rows, batch_id), or a NO_NEWS row if it is empty."""

    def each(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            batch = batch.sparkSession.createDataFrame([(NO_NEWS,)], "state string")
        sink(batch, number)

    writer = stream.writeStream.outputMode("update").foreachBatch(each).trigger(**(trigger or {"processingTime": "30 seconds"}))
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.start()


def latest_from(events: DataFrame, key: str, order: list[str], value: list[str]) -> DataFrame:
    """The newest event of each key."""
    best = F.max(F.struct(*order, *[v for v in value if v not in order]))
    return events.groupBy(key).agg(best.alias("b")).select(key, *(F.col(f"b.{v}").alias(v) for v in value))


def log_tail(spark: SparkSession, path: str, schema: str, keys: list[str], files_per_batch: int = 1) -> DataFrame:
    """A streaming count and sum by key over files that are appended to a folder of CSV logs."""
    log = spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_per_batch).csv(path)
    return log.groupBy(*keys).agg(F.count("*").alias("n"))


def tail_counts(counts: DataFrame, keys: list[str], folder: str, checkpoint: str, trigger: dict | None = None):
    """Starts a query that keeps a streaming count (log_tail) as a table below folder: each micro-batch adds the
    counts that it changed, in the hash buckets of their keys. A batch that runs again replaces itself."""
    writer = counts.writeStream.outputMode("update").foreachBatch(lambda batch, number: write_delta(batch, folder, keys, number))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "30 seconds"})).start()


def read_counts(spark: SparkSession, folder: str, schema, keys: list[str]) -> DataFrame:
    """The table of tail_counts: the newest count of each key."""
    return latest(read_deltas(spark, folder, schema), keys)
