"""Structured Streaming: incremental keyed upserts and windowed counts with late data."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import upsert


def upsert_stream(spark: SparkSession, source: str, target: str, keys: list[str], checkpoint: str, schema: str, files_per_trigger: int = 100):
    """Merges parquet files that arrive in ``source`` into the table ``target``; a batch that is replayed changes nothing."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    return stream.writeStream.foreachBatch(lambda batch, _: upsert(target, batch, keys) if batch.limit(1).count() else None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", value: str = "value", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, kind, n, total) per tumbling window; works on a stream (with a watermark) and on a table alike."""
    x = events.withWatermark(ts, late) if events.isStreaming else events
    return x.groupBy(F.window(ts, width).alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").alias("window_start"), "kind", "n", "total")


def deduplicated(events: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark; on a table simply once."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """(user, session_start, session_end, n): events of a user without a gap of that length."""
    x = events.withWatermark(ts, "1 hour") if events.isStreaming else events
    return x.groupBy(F.col(user).alias("user"), F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select("user", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
