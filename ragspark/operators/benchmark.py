"""The strategies' benchmark (D17, E13, E16, G9, I45): sampled questions, all strategies over all of them, comparisons, a stored run."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from . import evaluation as ev
from . import retrieval
from .filters import usable_text
from .postings import TextIndex
from .retrieval import STRATEGIES

RUN = "timestamp timestamp, num_queries long, top_k int, embedding_model string, strategy_metrics map<string, struct<avg_latency_ms:double, queries:long, results:long>>, comparisons map<string, struct<avg_overlap:double, min_overlap:double, max_overlap:double, avg_rank_correlation:double>>"
LISTS = "strategy string, query_id long, rank long, chunk_id long"


def sampled_questions(chunks: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """query_id, words, vector of n chunks with enough text, chosen by a hash of their id: the first sentence as a question, the chunk's vector."""
    some = chunks.filter(usable_text()).orderBy(F.xxhash64(F.lit(seed), F.col("chunk_id")), "chunk_id").limit(n)
    return some.select(F.col("chunk_id").alias("query_id"), tx.synthesized_query(F.col("text")).alias("words"), F.col("embedding").alias("vector"))


def strategy_list(name: str, chunks: DataFrame, mentions: DataFrame, queries: DataFrame, k: int, index: TextIndex | None = None, near: DataFrame | None = None, matching: DataFrame | None = None) -> DataFrame:
    """strategy, query_id, rank, chunk_id: what a strategy finds for all questions (query_id, words, vector), in one plan.

    `near` and `matching` are the questions' 3 k nearest chunks and best matches, if the caller has them.
    """
    if name == STRATEGIES[0]:
        found = retrieval.batch_nearest(chunks, queries, k) if near is None else near.filter(F.col("rank") <= k)
    elif name == STRATEGIES[1]:
        found = retrieval.batch_boost(chunks, mentions, queries, k, near=near)
    elif name in STRATEGIES:
        found = retrieval.batch_hybrid(chunks, mentions, queries, k, fusion="rrf" if name == STRATEGIES[2] else "weighted", index=index, near=near, matching=matching)
    else:
        raise ValueError(f"no strategy is called {name}")
    return found.select(F.lit(name).alias("strategy"), "query_id", "rank", "chunk_id")


def strategy_lists(chunks: DataFrame, mentions: DataFrame, queries: DataFrame, path: str, k: int, index: TextIndex | None = None) -> dict[str, DataFrame]:
    """strategy_list() of all strategies, which share one search by vector and one by text: those are stored at path/near and path/matching."""
    shared = {"near": retrieval.batch_nearest(chunks, queries, 3 * k), "matching": retrieval.batch_matches(chunks, queries, 3 * k, index=index)}
    for name, df in shared.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        shared[name] = chunks.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")
    return {name: strategy_list(name, chunks, mentions, queries, k, index, **shared) for name in STRATEGIES}


def comparisons(lists: DataFrame, base: str = STRATEGIES[0]) -> DataFrame:
    """strategy, avg_overlap, min_overlap, max_overlap, avg_rank_correlation of each strategy's lists with the base's, over the questions."""
    runs = {n: lists.filter(F.col("strategy") == n).drop("strategy") for n in STRATEGIES}
    by_query = ev.compare_runs(runs, base)
    # Means of millionths are sums of whole numbers: the same whatever the order of the rows.
    mean = lambda c: F.sum(F.round(F.col(c) * 1e6).cast("long")) / F.count(F.lit(1)) / F.lit(1e6)
    return by_query.groupBy("strategy").agg(mean("jaccard").alias("avg_overlap"), F.min("jaccard").alias("min_overlap"), F.max("jaccard").alias("max_overlap"), mean("rank_correlation").alias("avg_rank_correlation"))


def run(chunks: DataFrame, mentions: DataFrame, queries: DataFrame, path: str, k: int = 10, model: str | None = None, index: TextIndex | None = None) -> DataFrame:
    """Runs all strategies over the questions and stores the run: path/lists by strategy, path/run a row with the settings, times and comparisons.

    A time is that of all questions together by their number. Returns the run's row.
    """
    spark, pool = chunks.sparkSession, retrieval.of_model(chunks, model)
    asked = f"{path}/questions"
    queries.write.mode("overwrite").parquet(asked)
    queries = spark.read.schema(queries.schema).parquet(asked)
    n, metrics = queries.count(), {}
    for name in STRATEGIES:
        began, place = time.perf_counter(), f"{path}/lists/strategy={name}"
        strategy_list(name, pool, mentions, queries, k, index).drop("strategy").write.mode("overwrite").parquet(place)
        took = (time.perf_counter() - began) * 1000
        metrics[name] = (took / max(1, n), n, spark.read.parquet(place).count())
    compared = {r.strategy: tuple(r)[1:] for r in comparisons(stored_lists(spark, path)).collect()}
    now = spark.range(1).select(F.current_timestamp().alias("t")).first().t
    spark.createDataFrame([(now, n, k, model, metrics, compared)], RUN).coalesce(1).write.mode("overwrite").json(f"{path}/run")
    return stored_run(spark, path)


def stored_run(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN).json(f"{path}/run")


def stored_lists(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LISTS).parquet(f"{path}/lists").select("strategy", "query_id", "rank", "chunk_id")


def table(run: DataFrame) -> DataFrame:
    """strategy, avg_latency_ms, queries, results, avg_overlap, avg_rank_correlation: a stored run as rows; the base has no comparison."""
    m = run.select(F.explode("strategy_metrics").alias("strategy", "m"), "comparisons")
    c = F.try_element_at("comparisons", F.col("strategy"))
    return m.select("strategy", "m.*", c["avg_overlap"].alias("avg_overlap"), c["avg_rank_correlation"].alias("avg_rank_correlation"))
