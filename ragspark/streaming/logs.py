"""Structured Streaming over what the engine appends (K1-K3)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.experiments import statistics
from ..schemas import AB_EVENTS


def ab_log(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    """K2: the JSONL log as a stream; K4: files_a_batch bounds a batch."""
    return spark.readStream.schema(AB_EVENTS).option("maxFilesPerTrigger", files_a_batch).json(path)


def running_statistics(log: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """K2: the statistics so far, all strategies anew with each batch (their number is small)."""
    return statistics(log).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def incremental(spark: SparkSession, path: str, schema, checkpoint: str, work: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """K1: what was appended since the last run, each row once; the checkpoint is the high-water mark."""
    return spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_statistics(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """An extension: queries and mean latency by strategy and time window; later rows than `late` go."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", window).alias("w"), "strategy").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms")).select(F.col("w.start").alias("window_start"), "strategy", "queries", "avg_latency_ms")
