"""A session with the settings that the engine expects, the folder that its nodes share, and what is done to files there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def session(master: str = "local[*]", name: str = "ragspark", **conf) -> SparkSession:
    """UTC, adaptive plans; every other setting is the cluster's unless named here."""
    b = SparkSession.builder.master(master).appName(name)
    for k, v in ({"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.enabled": "false"} | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a local folder, which only a local master can use."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="ragspark-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place


def _file_system(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def delete(spark: SparkSession, path: str) -> None:
    fs, path = _file_system(spark, path)
    fs.delete(path, True)


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; it goes when the driver ends."""
    fs, path = _file_system(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return str(path.toString())


def listing(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """Name, length and time of a table's files, as one listing tells them; () if there are none."""
    fs, path = _file_system(spark, path)
    if not fs.exists(path):
        return ()
    found = [fs.getFileStatus(path)] if not fs.getFileStatus(path).isDirectory() else list(fs.listStatus(path))
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


def small_batches(spark: SparkSession) -> None:
    """Bounds this session's Arrow batches by 2 MB, unless its owner has set the bound: a worker's memory then does not grow with texts or vectors."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(2 << 20))
