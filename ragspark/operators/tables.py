"""Tables that are changed in place, a few partitions at a time (B1-B5): only what new keys touch is read and written.

A table is folders by `bucket`, a function of its key. A change collects the buckets of its keys (as
many as the table has folders, at most), merges them with those folders' rows, stores the result
apart, and overwrites these folders alone. Every merge gives the same again when it is repeated, so
a change that fails half-way is run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete, own_folder
from .storage import merge_rows

#: How the table's rows and the new rows of its buckets become the new rows of these buckets.
Merge = Callable[[DataFrame, DataFrame], DataFrame]


def by_range(key: str, width: int) -> Column:
    """Buckets of `width` consecutive numbers: keys that come together lie together. A null key has bucket -1."""
    return F.coalesce(F.floor(F.col(key) / width), F.lit(-1)).cast("long")


def by_hash(key: str, buckets: int) -> Column:
    """A fixed number of buckets, for keys without an order."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("long")


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, bucket: Column):
        self.spark, self.path, self.schema, self.bucket = spark, path, schema, bucket

    @classmethod
    def create(cls, rows: DataFrame, path: str, bucket: Column) -> KeyedTable:
        """A new table of these rows; a bucket is a task's and a file's, so choose them of a file's size."""
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        table = cls(rows.sparkSession, path, schema, bucket)
        rows.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        return table

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets, whose folders alone are read."""
        t = self.spark.read.schema(f"{self.schema}, bucket long").parquet(self.path)
        t = t if buckets is None else t.filter(F.col("bucket").isin(buckets))
        return t.drop("bucket")

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of these keys, one of each."""
        return sorted(r.bucket for r in keys.select(self.bucket.alias("bucket")).distinct().collect())

    def change(self, new: DataFrame, merge: Merge) -> list[int]:
        """Merges new rows into their buckets; returns the buckets that were written. Rows may not move to other buckets."""
        buckets = self.touched(new)
        if not buckets:
            return []
        place = own_folder(self.spark, "change")
        columns = self.rows([]).columns
        merge(self.rows(buckets), new).select(columns).write.mode("overwrite").parquet(f"{place}/merged")
        merged = self.spark.read.schema(self.schema).parquet(f"{place}/merged").withColumn("bucket", self.bucket)
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        kept = {r.bucket for r in merged.select("bucket").distinct().collect()}
        for b in set(buckets) - kept:  # nothing is left of them
            delete(self.spark, f"{self.path}/bucket={b}")
        delete(self.spark, place)
        return buckets

    def upsert(self, new: DataFrame, key: list[str]) -> list[int]:
        """New rows hold where they have a value; what is null in them stays as it was (B1, column by column)."""
        return self.change(new, lambda old, rows: merge_rows(old, rows, key))

    def replace(self, new: DataFrame, key: list[str]) -> list[int]:
        """New rows hold whole (B2)."""
        return self.change(new, lambda old, rows: old.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True))

    def append(self, new: DataFrame, key: list[str]) -> list[int]:
        """New rows whose key is not there yet, nulls being equal; of equal new ones one."""

        def absent(old: DataFrame, rows: DataFrame) -> DataFrame:
            o = old.select(F.struct(*key).alias("_there"))
            fresh = rows.join(o, F.struct(*key).eqNullSafe(F.col("_there")), "left_anti").dropDuplicates(key)
            return old.unionByName(fresh, allowMissingColumns=True)

        return self.change(new, absent)

    def remove(self, keys: DataFrame, key: list[str]) -> list[int]:
        """Without the rows of these keys (B3); `keys` has what the bucket is made of."""
        return self.change(keys, lambda old, rows: old.join(rows.select(key).distinct(), key, "left_anti"))
