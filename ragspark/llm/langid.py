"""Language identification by a string kernel: blended-spectrum presence, Nyström landmarks, one-versus-rest ridge regression."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chargrams import gram_hashes
from .common import Scratch, arrow_out, crc_mod, release, runs, small_batches, text_column

LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


@dataclass
class Settings:
    """rows: labelled rows to fit on at most (the bounded sample); landmarks: of these, the first so many."""

    rows: int = 3000
    landmarks: int = 256
    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 16
    ridge: float = 1e-3
    sharpness: float = 8.0


def presence(text: str, orders, bits: int) -> np.ndarray:
    """The n-grams present (as hashed to 2**bits; those that share a hash count as one), sorted."""
    seen = np.zeros(1 << bits, bool)
    for h in gram_hashes(text, orders):
        seen[h >> np.uint64(64 - bits)] = True
    return seen.nonzero()[0]


def products(grams: list[np.ndarray], matrix: np.ndarray, block: int = 64) -> np.ndarray:
    """The texts' presence rows, scaled to length 1, times `matrix`: a product a block of texts, over the n-grams that occur in it."""
    out, place = np.zeros((len(grams), matrix.shape[1])), np.zeros(len(matrix), np.int64)
    for s in range(0, len(grams), block):
        part = grams[s : s + block]
        sizes, columns = np.asarray([len(g) for g in part]), np.concatenate(part)
        present = np.zeros(len(matrix), bool)
        present[columns] = True
        used = present.nonzero()[0]
        place[used] = np.arange(len(used))
        rows = np.zeros((len(part), len(used)), np.float32)
        rows[np.repeat(np.arange(len(part)), sizes), place[columns]] = 1
        out[s : s + block] = (rows @ matrix[used]) / np.sqrt(np.maximum(1, sizes))[:, None]
    return out


@dataclass
class Model:
    """weights: n-gram by language, the landmarks' normalised presence times the dual coefficients."""

    langs: list[str]
    weights: np.ndarray
    settings: Settings

    def scores(self, grams: list[np.ndarray]) -> np.ndarray:
        """One row a text: its kernel values with the landmarks times their coefficients."""
        return products(grams, self.weights)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [bool(t) and LETTER.search(t) is not None for t in texts]
        s = self.scores([presence(t, self.settings.orders, self.settings.bits) if k else np.zeros(0, int) for t, k in zip(texts, known, strict=True)])
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        e = np.exp(self.settings.sharpness * (s - s.max(axis=1, keepdims=True)))
        p, best = e / e.sum(axis=1, keepdims=True), s.argmax(axis=1)
        return [self.langs[b] if k else UNKNOWN for k, b in zip(known, best, strict=True)], [float(r[b]) if k else 0.0 for k, r, b in zip(known, p, best, strict=True)]


def fit_kernel(grams: list[np.ndarray], labels: list[str], settings: Settings) -> Model:
    """Kernel ridge regression on Nyström features of the presence kernel |A & B| / sqrt(|A| |B|).

    With K_m the landmarks' kernel and K_nm the rows' with them, the dual coefficients of each
    language's +1/-1 target solve (K_nm' K_nm + ridge n K_m) a = K_nm' y. The targets are weighted
    so that each language counts alike.
    """
    langs = sorted(set(labels))
    m = min(settings.landmarks, len(grams))
    if not m:
        return Model([], np.zeros((1 << settings.bits, 0), np.float32), settings)
    marks = np.zeros((1 << settings.bits, m), np.float32)
    for j, g in enumerate(grams[:m]):
        marks[g, j] = 1 / np.sqrt(max(1, len(g)))
    k = products(grams, marks)
    y = np.where(np.asarray(labels)[:, None] == np.asarray(langs)[None], 1.0, -1.0)
    counts = {x: labels.count(x) for x in langs}
    w = np.asarray([len(labels) / (len(langs) * counts[x]) for x in labels])[:, None]
    km = k[:m]
    a = np.linalg.solve(k.T @ (w * k) + settings.ridge * len(grams) * (km + km.T) / 2 + 1e-6 * np.eye(m), k.T @ (w * y))
    return Model(langs, (marks @ a.astype(np.float32)).astype(np.float32), settings)


def fit(spark: SparkSession, docs: DataFrame, settings: Settings = Settings(), fold: int = 4, held_out: int = 2) -> Model:
    """Learns from at most settings.rows doc_ids outside the fold, the languages in turn, each by smallest hash of doc_id.

    Only presence bits of one text an id come to the driver: bounded whatever the texts' lengths and
    however often an id is repeated (its smallest language and, in that, its smallest text hold).
    Rows of null id, lang or text and texts without a letter teach nothing.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", fold) != held_out)).select("doc_id", "lang", "text")
    scratch = Scratch(spark, "language-fit")
    ids = labelled.groupBy("doc_id").agg(F.min("lang").alias("lang")).withColumn("order", F.xxhash64("doc_id"))
    ids = scratch.save(ids.withColumn("range", F.expr("shiftright(order, 52)")), "ids")
    # The smallest hashes, by counts of their ranges first: no task ever holds a language's ids.
    upto = F.sum("count").over(Window.partitionBy("lang").orderBy("range"))
    ranges = ids.groupBy("lang", "range").count().withColumn("upto", upto).filter(F.col("upto") - F.col("count") < settings.rows).select("lang", "range")
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("order", "doc_id"))
    chosen = ids.join(ranges, ["lang", "range"]).withColumn("turn", turn).filter(F.col("turn") <= settings.rows).orderBy("turn", "lang").limit(settings.rows)
    chosen = scratch.save(chosen.select("doc_id", "lang", "turn"), "chosen")
    rows = labelled.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("turn", "lang").agg(F.min("text").alias("text"))
    orders, bits = settings.orders, settings.bits

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part in runs(batches):
            packed = []
            for t in text_column(part).to_pylist():
                seen = np.zeros(1 << bits, bool)
                if LETTER.search(t):
                    seen[presence(t, orders, bits)] = True
                packed.append(np.packbits(seen).tobytes())
            yield pa.RecordBatch.from_arrays([part.column("turn").cast(pa.int64()), pa.array(packed, pa.binary()), part.column("lang").cast(pa.string())], names=["turn", "bits", "lang"])

    got = rows.mapInArrow(each, "turn long, bits binary, lang string").toArrow().to_pydict()
    scratch.close()
    order = sorted(range(len(got["turn"])), key=lambda i: (got["turn"][i], got["lang"][i]))
    grams = [np.unpackbits(np.frombuffer(got["bits"][i], np.uint8)).nonzero()[0] for i in order]
    taught = [(g, got["lang"][i]) for g, i in zip(grams, order, strict=True) if len(g)]
    return fit_kernel([g for g, _ in taught], [x for _, x in taught], settings)


def identify(spark: SparkSession, docs: DataFrame, model: Model, fold: int = 4, held_out: int = 2) -> DataFrame:
    """A row per document: predicted language (`und` if the text is null or has no letter) and its share of the scores.

    The share is a softmax over the languages' regression values; `und` scores 0. Null doc_id: the
    fold of the empty text. Repeated rows: a row each. Empty table: no rows; nothing to learn from:
    all `und`. The whole text counts, however long. Other columns are not read.
    """
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # 2**bits x languages floats

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
        for part in runs(batches):
            lang, score = shared.value.predict(text_column(part).to_pylist())
            yield arrow_out(schema, {"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "lang_pred": lang, "score": score})

    return docs.select("doc_id", (crc_mod("doc_id", fold) == held_out).alias("held_out"), "text").mapInArrow(each, SCHEMA)


def keep_identified(docs: DataFrame, model: Model, spark: SparkSession) -> DataFrame:
    """`docs` without the rows that identify() calls `und`, and with the prediction where lang (if there) is null.

    Null texts, empty ones and those without a letter go; every other row stays, repeated rows too,
    whatever else is null in it. If nothing was learned no lang is filled in. The whole text counts,
    however long. Empty table: no rows. Other columns pass through.
    """
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part in runs(batches):
            texts = text_column(part).to_pylist()
            lang, _ = shared.value.predict(texts)
            if not shared.value.langs:  # a letter is all that a text needs
                lang = [None if t and LETTER.search(t) else UNKNOWN for t in texts]
            if (at := part.schema.get_field_index("lang")) >= 0:
                told = part.column(at)
                part = part.set_column(at, part.schema.field(at), pc.coalesce(told, pa.array([None if x == UNKNOWN else x for x in lang], told.type)))
            yield part.filter(pa.array([x != UNKNOWN for x in lang], pa.bool_()))

    return docs.mapInArrow(each, docs.schema)
