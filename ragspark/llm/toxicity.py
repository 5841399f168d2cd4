"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chargrams import gram_hashes
from .common import Scratch, arrow_out, crc_mod, release, runs, text_column

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


@dataclass
class Settings:
    """rows: labelled rows of each class to fit on at most (the bounded sample); features: n-grams kept."""

    rows: int = 2500
    orders: tuple[int, ...] = (4, 5, 6)
    bits: int = 20
    features: int = 4096
    smoothing: float = 1.0
    penalty: float = 1.0
    rounds: int = 300
    least: float = 0.7


def g_squared(p: np.ndarray, q: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """How much presence in p of n1 and q of n0 texts tells the classes apart (log-likelihood ratio)."""

    def term(a, n):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.nan_to_num(a * np.log(a / n)) + np.nan_to_num((n - a) * np.log((n - a) / n))

    return 2 * (term(p, n1) + term(q, n0) - term(p + q, n1 + n0))


@dataclass
class Model:
    """hashes: sorted n-gram hashes; weights: by hash, ratio times coefficient; where: a bitmap that most others miss."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float
    settings: Settings

    def __post_init__(self):
        self.where = np.zeros(1 << 20, bool)
        self.where[self.hashes >> np.uint64(44)] = True

    def features(self, text: str | None) -> np.ndarray:
        found = [np.zeros(0, np.uint64)]
        for h in gram_hashes(text or "", self.settings.orders):
            found.append(np.unique(h[self.where[h >> np.uint64(44)]]))
        h = np.unique(np.concatenate(found))
        if not len(h) or not len(self.hashes):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return at[self.hashes[at] == h]

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.weights[self.features(text)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def fit_weights(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, settings: Settings) -> tuple[np.ndarray, float]:
    """Logistic regression on presence times ratio, with an L2 penalty, by accelerated full gradient steps."""
    n, k = len(rows), len(ratios)
    if not n or not k:
        share = (labels.sum() + 1) / (n + 2)
        return np.zeros(k), float(np.log(share / (1 - share)))
    cols = np.concatenate(rows).astype(np.int64)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    values = ratios[cols]
    norm = np.bincount(owner, values**2, n).max() + 1
    w, v, b, vb = np.zeros(k), np.zeros(k), 0.0, 0.0
    step = 4.0 / (norm + 4 * settings.penalty / n)
    for t in range(settings.rounds):
        z = np.bincount(owner, values * v[cols], n) + vb
        g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels) / n
        new, nb = v - step * (np.bincount(cols, values * g[owner], k) + settings.penalty * v / n), vb - step * g.sum()
        if ((new - w) @ (v - new) + (nb - b) * (vb - nb)) > 0:  # the momentum points uphill: begin anew
            v, vb = new, nb
        else:
            v, vb = new + t / (t + 3) * (new - w), nb + t / (t + 3) * (nb - b)
        w, b = new, nb
    return w * ratios, float(b)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, scratch: Scratch, settings: Settings = Settings(), fold: int = 3, held_out: int = 1) -> Model:
    """Learns from at most settings.rows rows a class outside the fold, those with the smallest hash of doc_id.

    Counts of hashed n-grams choose buckets, the n-grams in these are counted by their full hashes,
    and settings.features of them, those that tell most, get the ratio log((p+s)/(q+s)) of their
    shares and a coefficient. The driver gets counts by bucket and presence rows of chosen n-grams,
    both bounded by the settings. Rows of null id or label teach nothing; of a document with both
    labels, 1 holds.
    """
    said = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (crc_mod("doc_id", fold) != held_out)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    there = said.join(docs.filter(F.col("doc_id").isNotNull()).select("doc_id").distinct(), "doc_id", "left_semi")
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = there.filter("toxic = 1").orderBy(*order).limit(settings.rows).unionByName(there.filter("toxic = 0").orderBy(*order).limit(settings.rows))
    chosen = scratch.save(chosen.coalesce(1), "chosen")
    text = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).drop("doc_id")
    sample = scratch.save(text.repartition(4, F.xxhash64("text")), "sample")
    orders, bits = settings.orders, settings.bits

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros((2, 1 << bits), np.int32), np.zeros(2, np.int64)
        for batch in batches:
            for t, y in zip(text_column(batch).to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                seen = np.zeros(1 << bits, bool)
                for h in gram_hashes(t or "", orders):
                    seen[h >> np.uint64(64 - bits)] = True
                counts[y] += seen
                n[y] += 1
        yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in counts] + [pa.array([int(x)]) for x in n], names=["q", "p", "n0", "n1"])

    q, p, n0, n1 = np.zeros(1 << bits), np.zeros(1 << bits), 0, 0
    for r in sample.mapInArrow(buckets, "q binary, p binary, n0 long, n1 long").toLocalIterator():
        q, p, n0, n1 = q + np.frombuffer(r.q, np.int32), p + np.frombuffer(r.p, np.int32), n0 + r.n0, n1 + r.n1
    wanted = np.zeros(1 << bits, bool)
    if n0 and n1:
        g = np.where(p + q >= 2, g_squared(p, q, n1, n0), 0)
        best = np.argsort(-g, kind="stable")[: settings.features]
        wanted[best[g[best] > 0]] = True

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in text_column(batch).to_pylist():
                found = [h[wanted[h >> np.uint64(64 - bits)]] for h in gram_hashes(t or "", orders)]
                rows.append(np.unique(np.concatenate([*found, np.zeros(0, np.uint64)])).astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column("toxic").cast(pa.int32())], names=["grams", "toxic"])

    got = sample.mapInArrow(within, "grams binary, toxic int").toArrow().to_pydict()
    both = sorted(zip(got["grams"], got["toxic"], strict=True))
    rows = [np.frombuffer(b, np.int64).astype(np.uint64) for b, _ in both]
    y = np.asarray([t for _, t in both], np.float64)
    hashes, at = np.unique(np.concatenate([*rows, np.zeros(0, np.uint64)]), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    p = np.bincount(at[y[owner] == 1], minlength=len(hashes)) if len(rows) else np.zeros(0)
    q = np.bincount(at[y[owner] == 0], minlength=len(hashes)) if len(rows) else np.zeros(0)
    if len(hashes):
        top = np.sort(np.argsort(-g_squared(p.astype(float), q.astype(float), n1, n0), kind="stable")[: settings.features])
        hashes, p, q = hashes[top], p[top], q[top]
    s = settings.smoothing
    ratios = np.log(((p + s) / (n1 + 2 * s)) / ((q + s) / (n0 + 2 * s)))
    model = Model(hashes, np.zeros(len(hashes)), 0.0, settings)
    place = []
    for r in rows:
        i = np.minimum(np.searchsorted(hashes, r), max(0, len(hashes) - 1)) if len(hashes) else np.zeros(0, int)
        place.append(i[hashes[i] == r] if len(i) else np.zeros(0, int))
    model.weights, model.bias = fit_weights(place, y, ratios, settings)
    scratch.drop("chosen", "sample")
    return model


def score(spark: SparkSession, docs: DataFrame, model: Model, fold: int = 3, held_out: int = 1) -> DataFrame:
    """A row per document: score from 0 to 1, and whether it reaches settings.least.

    The whole text counts, however long; null and empty texts get the score of a text without
    n-grams. Null doc_id: the fold of the empty text. Repeated rows: a row each. Empty table: no
    rows; nothing to learn from: the same score for all. Other columns are not read.
    """
    shared = spark.sparkContext.broadcast(model)  # settings.features weights and a bitmap of 1 MB

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
        m = shared.value
        for part in runs(batches):
            s = [m.score(t) for t in text_column(part).to_pylist()]
            yield arrow_out(schema, {"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": s, "predicted": [int(x >= m.settings.least) for x in s]})

    return docs.select("doc_id", (crc_mod("doc_id", fold) == held_out).alias("held_out"), "text").mapInArrow(each, SCHEMA)
