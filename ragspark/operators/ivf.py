"""An inverted-list index over vectors (G3, B9, B10, I50, E15): centroids, lists as partitions, one or many queries, a measured sweep."""

from __future__ import annotations

import math
import time
import warnings
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as vec
from ..session import delete
from .retrieval import batch_nearest, best_by_query, nearest, rows_of, tiles_nearest, unit_rows, whole

#: Rows of the training sample a list, at least: fewer give centroids that are single rows.
SAMPLE_PER_LIST = 50
#: Rows of a file of the sample, about: each is a task.
SAMPLE_ROWS = 8_192
#: Queries of a tile of search_many().
TILE_QUERIES = 4096
#: Pairs of a query and a list that a task of probes() holds at once.
PROBE_ROWS = 16_384


def suggested_lists(n: int) -> int:
    """One and a half times the root of the rows."""
    return max(1, round(1.5 * math.sqrt(n)))


def check_lists(nlist: int, n: int) -> bool:
    ok = math.sqrt(n) <= nlist <= 2 * math.sqrt(n)
    if not ok:
        warnings.warn(f"{nlist} lists for {n} rows: usual are {math.sqrt(n):.0f} to {2 * math.sqrt(n):.0f}", stacklevel=2)
    return ok


def default_probes(nlist: int) -> int:
    return max(1, nlist // 16)


class IvfIndex:
    def __init__(self, spark: SparkSession, path: str, centroids: np.ndarray):
        self.spark, self.path, self.centroids = spark, path, centroids

    @classmethod
    def build(cls, chunks: DataFrame, path: str, nlist: int = 96, model: str | None = None, sample: int = 100_000, seed: int = 1, file_rows: int = 500_000) -> IvfIndex:
        """Fits centroids on a sample (the rows of smallest hash), gives all rows their list, writes a folder a list.

        The sample has `sample` rows, or SAMPLE_PER_LIST a list where that is more, so that it grows
        with the lists. A list of more than file_rows rows (counted) is several parts, each a task, so
        a hot one is no single task. Vectors that are null, zero, or hold null or non-finite
        components are in no list.
        """
        c = chunks if model is None else chunks.filter(F.col("embedding_model") == model)
        norm = vec.norm(F.col("embedding"))
        c = c.filter(whole("embedding")).filter((norm > 0) & (norm < float("inf")))  # NaN is above all
        withv = c.withColumn("_v", array_to_vector(vec.as_double("embedding")))
        n = max(sample, SAMPLE_PER_LIST * nlist)
        few = c.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(n).select(vec.as_double("embedding").alias("v"))
        few.repartition(-(-n // SAMPLE_ROWS)).write.mode("overwrite").parquet(f"{path}/_sample")
        few = c.sparkSession.read.schema("v array<double>").parquet(f"{path}/_sample").select(array_to_vector("v").alias("_v"))
        # Blocks: the other solver brings the distances of all pairs of centroids to the driver, in a task a centroid, each time.
        fitted = KMeans(k=nlist, seed=seed, distanceMeasure="cosine", solver="block", featuresCol="_v", predictionCol="list_id").fit(few)
        delete(c.sparkSession, f"{path}/_sample")
        placed = fitted.transform(withv).drop("_v")
        parts = placed.groupBy("list_id").agg(F.count(F.lit(1)).alias("rows"))
        parts = parts.select("list_id", "rows", F.ceil(F.col("rows") / file_rows).cast("int").alias("parts"))
        parts.coalesce(1).write.mode("overwrite").parquet(f"{path}/_lists")
        parts = c.sparkSession.read.parquet(f"{path}/_lists")  # nlist rows
        placed = placed.join(F.broadcast(parts.select("list_id", "parts")), "list_id").withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int"))
        placed.repartition("list_id", "part").drop("parts").write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/rows")
        centers = [(i, [float(x) for x in v]) for i, v in enumerate(fitted.clusterCenters())]
        c.sparkSession.createDataFrame(centers, "list_id int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/_centroids")
        return cls(c.sparkSession, path, np.asarray([v for _, v in centers]))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> IvfIndex:
        """An index that was built before; its centroids (nlist rows) come to the driver."""
        rows = spark.read.parquet(f"{path}/_centroids").orderBy("list_id").collect()
        return cls(spark, path, np.asarray([r.centroid for r in rows]))

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def verify(self) -> DataFrame:
        """list_id and rows of each list; only partition folders and counts are read."""
        return self.rows().groupBy("list_id").agg(F.count(F.lit(1)).alias("rows"))

    def drop(self) -> None:
        delete(self.spark, self.path)

    def search(self, query: Sequence[float], k: int = 10, nprobe: int | None = None) -> DataFrame:
        """Exact within the nprobe lists whose centroids are nearest; only their folders are read."""
        n = default_probes(len(self.centroids)) if nprobe is None else nprobe
        lists = nearest_lists(np.asarray([query], float), self.centroids, n)[0]
        return nearest(self.rows().filter(F.col("list_id").isin([int(i) for i in lists])), query, k)

    def probes(self, queries: DataFrame, nprobe: int) -> DataFrame:
        """query_id, vector, list_id: each query (query_id, vector) once for each list that it looks in. The centroids, nlist rows, are broadcast."""
        shared = self.spark.sparkContext.broadcast(self.centroids)
        schema = pa.schema([("query_id", pa.int64()), ("vector", pa.list_(pa.float64())), ("list_id", pa.int32())])

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = max(1, PROBE_ROWS // len(shared.value))  # of queries: what they give, and their products, stay small whatever the lists
            for whole_batch in batches:
                for begin in range(0, whole_batch.num_rows, step):
                    b = whole_batch.slice(begin, step)
                    x, good = unit_rows(rows_of(b.column("vector"), b.num_rows))
                    lists = nearest_lists(x, shared.value, nprobe)
                    at = pa.array(np.repeat(good, lists.shape[1]))
                    yield pa.RecordBatch.from_arrays([b.column("query_id").take(at), b.column("vector").take(at), pa.array(lists.ravel(), pa.int32())], schema=schema)

        q = queries.filter(whole("vector") & (F.size("vector") == self.centroids.shape[1])).select(F.col("query_id").cast("long").alias("query_id"), vec.as_double("vector").alias("vector"))
        return q.mapInArrow(each, "query_id long, vector array<double>, list_id int")

    def search_many(self, queries: DataFrame, k: int = 10, nprobe: int | None = None) -> DataFrame:
        """query_id, rank, chunk_id, similarity: the k nearest of each query within the lists that it looks in.

        Queries meet the parts of their lists there: a tile is a part and TILE_QUERIES queries, about,
        and returns k rows a query. Lists that no query looks in are not read: their numbers (nlist at
        most) prune the folders. Queries without a direction have no rows.
        """
        n = min(default_probes(len(self.centroids)) if nprobe is None else nprobe, len(self.centroids))
        lists = self.spark.read.parquet(f"{self.path}/_lists")
        asked = self.probes(queries, n)
        counted = asked.groupBy("list_id").agg(F.ceil(F.count(F.lit(1)) / TILE_QUERIES).cast("int").alias("blocks")).join(F.broadcast(lists), "list_id").select("list_id", "blocks", "parts").collect()
        if not counted:
            return best_by_query(nearest_none(self.spark), k)
        sizes = self.spark.createDataFrame([tuple(r) for r in counted], "list_id int, blocks int, parts int")
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        q = asked.join(F.broadcast(sizes), "list_id").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).withColumn("part", every("parts"))
        c = self.rows().filter(F.col("list_id").isin([r.list_id for r in counted])).join(F.broadcast(sizes), "list_id").withColumn("block", every("blocks"))
        return best_by_query(tiles_nearest(c, q, ["list_id", "part", "block"], k), k)


def nearest_none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "query_id long, chunk_id long, similarity double")


def nearest_lists(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n lists of the nearest centroids for each row, nearest first."""
    c = centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    return np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :n]


def recall(found: DataFrame, exact: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, recall: the share of each query's true neighbours that was found; 1 where it has none."""
    hit = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    shares = hit.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    return queries.select("query_id").join(shares, "query_id", "left").withColumn("recall", F.coalesce("recall", F.lit(1.0)))


def sweep(chunks: DataFrame, queries: DataFrame, path: str, nlists: Sequence[int], nprobes: Sequence[int], k: int = 10) -> DataFrame:
    """Nlist, nprobe, num_queries, recalls (avg, median, min, max), avg_query_time_ms, build_time_sec, exact_search_avg_ms.

    Each index is built once under `path`, searched for all queries (query_id, vector) by each
    nprobe up to its lists, measured against the exact neighbours, and dropped. Times are of whole
    batches, by the number of queries.
    """
    spark, truth = chunks.sparkSession, f"{path}/exact"
    n = max(1, queries.count())
    began = time.perf_counter()
    batch_nearest(chunks, queries, k).write.mode("overwrite").parquet(truth)
    exact_ms, exact = (time.perf_counter() - began) * 1000 / n, spark.read.parquet(truth)
    rows = []
    for nlist in nlists:
        began = time.perf_counter()
        index = IvfIndex.build(chunks, f"{path}/lists-{nlist}", nlist)
        built = time.perf_counter() - began
        for nprobe in dict.fromkeys(min(p, len(index.centroids)) for p in nprobes):
            began, out = time.perf_counter(), f"{path}/found-{nlist}-{nprobe}"
            index.search_many(queries, k, nprobe).write.mode("overwrite").parquet(out)
            took = (time.perf_counter() - began) * 1000 / n
            r = recall(spark.read.parquet(out), exact, queries).agg(F.avg("recall"), F.percentile_approx("recall", 0.5), F.min("recall"), F.max("recall")).first()
            rows.append((nlist, nprobe, queries.count(), *(None if x is None else round(float(x), 6) for x in r), took, built, exact_ms))
        index.drop()
    return spark.createDataFrame(rows, "nlist int, nprobe int, num_queries long, avg_recall double, median_recall double, min_recall double, max_recall double, avg_query_time_ms double, build_time_sec double, exact_search_avg_ms double")
