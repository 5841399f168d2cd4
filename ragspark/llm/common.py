"""Shared pieces of the training-data operators: scratch tables, tokens, hashes."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: Fixed value: what the contracts call a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step works on; bounds a worker's memory.
SLICE_BYTES = 2 << 20

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch on its way to a worker. Batches of thousands of long texts leave the
#: executor's native memory in large pieces that it does not get back; workers put small ones together.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds this session's Arrow batches by bytes, unless its owner has set the bound; lazy results need it after this call."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive executors.

    They go when dropped, all of them at close(), and whatever is left when the driver ends. A result
    that an operator returns may still read some, so close() comes after that has been written.
    """

    _scope: ContextVar[list["Scratch"] | None] = ContextVar("scratch-scope", default=None)

    @classmethod
    @contextmanager
    def scope(cls) -> Iterator[None]:
        """What is opened within, by the same thread, is closed at the end; nobody else's is."""
        mine: list[Scratch] = []
        token = cls._scope.set(mine)
        try:
            yield
        finally:
            cls._scope.reset(token)
            for s in mine:
                s.close()

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        fs, path = self._on_disk(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        if (mine := Scratch._scope.get()) is not None:
            mine.append(self)

    def _on_disk(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            fs, path = self._on_disk(self.path(name))
            fs.delete(path, True)

    def close(self) -> None:
        fs, path = self._on_disk(self.root)
        fs.delete(path, True)


def crc_mod(id_column: str, m: int) -> Column:
    """crc32 of the id as text, mod m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % F.lit(m)


def crc_mod_py(doc_id: int | None, m: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % m


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(words: pa.Array) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in words.to_pylist()), np.uint64, len(words))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch's rows in runs of about `limit` bytes of text; one long text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, run = 0, 0
    for i, n in enumerate(sizes):
        if run and run + n > limit:
            yield batch.slice(start, i - start)
            start, run = i, 0
        run += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def runs(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in runs of about `limit` bytes of text: small batches together, large ones in slices."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, column, limit):
            n = pc.sum(pc.binary_length(part.column(column))).as_py() or 0
            if held and size + n > limit:
                yield pa.concat_batches(held) if len(held) > 1 else held[0]
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield pa.concat_batches(held) if len(held) > 1 else held[0]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words (A-Z lowered), each token's index among them, and the tokens' offsets by text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), out=ends[1:])
    empty = pc.index(words, "").as_py()
    if empty >= 0:  # a text that begins or ends with white space
        kept = codes != empty
        before = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(kept, out=before[1:])
        codes, ends = codes[kept], before[ends]
    return words, codes, ends


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    column = batch.column(name)
    return column if pa.types.is_string(column.type) else column.cast(pa.string())


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-word shingles (64-bit) of one text's word hashes; a shorter text is one shingle."""
    if not len(hashes):
        return hashes
    if len(hashes) < n:
        x = np.asarray([len(hashes)], np.uint64)
        for h in hashes:
            x = mix(x * _A + h)
        return x
    x = hashes[: len(hashes) - n + 1] * _B
    for k in range(1, n):
        x = mix(x) * _A + hashes[k : len(hashes) - n + 1 + k] * _C
    return np.unique(mix(x))


#: What an operator keeps in a worker between its tasks; a task of another one clears it.
CACHES: list[dict] = []


def release() -> None:
    for cache in CACHES:
        cache.clear()
    trim()


def trim() -> None:
    """Gives freed memory back at a task's end; workers are kept and would hold it. Large arrays go back as soon as they are freed."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 512 << 10)  # M_MMAP_THRESHOLD: fixed, else it grows with what is freed
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shrink_heaps(spark: SparkSession) -> None:
    """Lets executors collect their garbage, so that heaps which a stage of large shuffles has grown are given back.

    A Python-heavy stage that follows needs the memory outside the heap. An executor that gets no
    task here only keeps its heap; nothing else depends on it.
    """
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def arrow_out(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)
