"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import strip


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """An id a line; blank lines go."""
    return spark.read.text(path).select(strip(F.col("value")).alias("id")).filter("id <> ''")


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Lines that are not JSON are rows of nulls."""
    return spark.read.schema(schema).json(path)


def json_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A document a file; missing paths give no rows."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return spark.read.schema(schema).option("multiLine", True).json(path) if there else spark.createDataFrame([], schema)


def sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """N rows at random, the same on every run: those of the smallest hashes of the key."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def has_column(df: DataFrame, name: str) -> bool:
    """A19."""
    return name in df.columns


def has_table(spark: SparkSession, name: str) -> bool:
    """A19."""
    return spark.catalog.tableExists(name)


def setting(spark: SparkSession, name: str, default: str | None = None) -> str | None:
    """What a setting holds, or the default where it is unset."""
    return spark.conf.get(name, default)


def table_columns(spark: SparkSession, name: str) -> DataFrame:
    """Column, type, whether it is a partition's; no rows for a table that is not there."""
    found = spark.catalog.listColumns(name) if has_table(spark, name) else []
    return spark.createDataFrame([(c.name, c.dataType, c.isPartition) for c in found], "column string, type string, is_partition boolean")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Arrays and maps as JSON text."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)
