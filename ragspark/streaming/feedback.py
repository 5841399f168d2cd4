"""Feedback that comes later than what it is on, and sinks that a replay does not change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def with_late_feedback(interactions: DataFrame, feedback: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Each interaction (experiment_id, ts, ...) with its feedback (experiment_id, ts, clicked_chunk_ids, user_rating) of the time `within` it, or nulls.

    Rows come in any order, up to `late` behind the newest. Repeated feedback of an interaction counts
    once, the first that came; an interaction whose feedback never comes is given out when it could
    not come any more, and its state goes. Over streams that is one outer join under two watermarks.
    """
    i = interactions.withWatermark("ts", late).alias("i")
    f = feedback.select("experiment_id", F.col("ts").alias("given"), "clicked_chunk_ids", "user_rating").withWatermark("given", late)
    f = f.dropDuplicatesWithinWatermark(["experiment_id"]) if f.isStreaming else f.dropDuplicates(["experiment_id"])
    f = f.alias("f")
    on = F.expr(f"i.experiment_id = f.experiment_id AND f.given >= i.ts AND f.given <= i.ts + INTERVAL {within}")
    return i.join(f, on, "left_outer").select("i.*", F.col("f.given").alias("feedback_ts"), F.col("f.clicked_chunk_ids").alias("clicked_chunk_ids"), F.col("f.user_rating").alias("user_rating"))


def committed(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch is a folder of its number, which a replay of the batch writes over."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def read_committed(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path).drop("batch")


def once(work: Callable[[DataFrame], None], path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: `work` that gives the same when repeated, skipped for batches whose mark is under `path`; the mark is written last."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        marks = f"{path}/done"
        try:
            last = spark.read.schema("number long").parquet(marks).agg(F.max("number")).first()[0]
        except Exception as e:  # no batch has ended yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            last = None
        if last is not None and number <= last:
            return
        work(batch)
        spark.createDataFrame([(number,)], "number long").coalesce(1).write.mode("append").parquet(marks)

    return run


def start(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs to the end of what is there, committing batch by batch under `path`."""
    return df.writeStream.outputMode("append").foreachBatch(committed(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
