"""A/B assignment, logs and statistics."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.identifiers import assigned
from ..schemas import AB_EVENTS


@dataclass
class Experiment:
    """Strategies in order of registration, with weights."""

    names: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    functions: dict[str, Callable] = field(default_factory=dict)

    def register(self, name: str, fn: Callable | None = None, weight: float = 1.0) -> None:
        if name not in self.names:
            self.names.append(name)
            self.weights.append(weight)
        self.weights[self.names.index(name)] = weight
        self.functions[name] = fn

    def consistent(self, user: Column) -> Column:
        """The same user, the same strategy."""
        return F.element_at(F.lit(self.names), (assigned(user, len(self.names)) + 1).cast("int"))

    def weighted(self, seed: int = 0, uniform: bool = False) -> Column:
        """At random, by weight or evenly."""
        w = [1.0] * len(self.names) if uniform else self.weights
        total, up, r, out = sum(w), 0.0, F.rand(seed), None
        for name, x in zip(self.names, w, strict=True):
            up += x / total
            out = F.when(r < up, F.lit(name)) if out is None else out.when(r < up, F.lit(name))
        return out.otherwise(F.lit(self.names[-1]))

    def assign(self, users: DataFrame, method: str = "consistent", seed: int = 0, forced: str | None = None) -> DataFrame:
        """Users (user_id, session_id) with strategy and experiment_id."""
        if forced:
            return users.withColumn("strategy", F.lit(forced)).withColumn("experiment_id", F.lit(f"forced_{forced}"))
        s = self.consistent(F.coalesce("user_id", F.lit(""))) if method == "consistent" else self.weighted(seed, method == "random")
        return users.withColumn("strategy", s).withColumn("experiment_id", F.uuid())


def interactions(rows: DataFrame) -> DataFrame:
    """Rows in the log's shape, as user_interaction events."""
    have = {f.name: f.dataType for f in StructType.fromDDL(AB_EVENTS)}
    out = rows.withColumn("event", F.lit("user_interaction"))
    return out.select(*[(F.col(n) if n in out.columns else F.lit(None)).cast(t).alias(n) for n, t in have.items()])


def append_log(rows: DataFrame, path: str) -> None:
    """B11."""
    rows.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A15."""
    return spark.read.schema(AB_EVENTS).json(path)


def statistics(log: DataFrame) -> DataFrame:
    """Ratings of 0 count as none; clicks by query may exceed 1."""
    e = log.filter("event = 'user_interaction'")
    clicks = F.coalesce(F.array_size("clicked_chunk_ids"), F.lit(0))
    return e.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("queries"),
        F.round(F.sum("latency_ms") / F.count(F.lit(1)), 6).alias("avg_latency_ms"),
        F.round(F.sum(clicks) / F.count(F.lit(1)), 6).alias("click_through"),
        F.round(F.avg(F.when(F.col("user_rating") != 0, F.col("user_rating"))), 6).alias("avg_rating"),
    )


def with_feedback(log: DataFrame, feedback: DataFrame) -> DataFrame:
    """Clicks and ratings that came later, joined by experiment_id."""
    f = feedback.select("experiment_id", F.col("clicked_chunk_ids").alias("_c"), F.col("user_rating").alias("_r"))
    out = log.join(f, "experiment_id", "left")
    return out.withColumn("clicked_chunk_ids", F.coalesce("_c", "clicked_chunk_ids")).withColumn("user_rating", F.coalesce("_r", "user_rating")).select(*log.columns)


def new_experiment_id() -> str:
    return str(uuid.uuid4())


def export(log: DataFrame, path: str) -> DataFrame:
    """The statistics by strategy, written as JSON lines beside the interactions they come from; returns them."""
    stats = statistics(log)
    stats.write.mode("overwrite").json(f"{path}/stats")
    log.filter("event = 'user_interaction'").write.mode("overwrite").json(f"{path}/interactions")
    return stats
