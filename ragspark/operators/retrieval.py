"""The four retrieval strategies, filtered search, mention search, batched search (G1-G13, A.5).

Scores are rounded to 6 places and ties go to the smaller chunk_id, so results are the same on
every run. Candidates carry ids and scores only; text and metadata are joined to the last k.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fulltext
from ..functions import text as tx
from ..functions import vectors as vec
from ..functions.identifiers import doc_ref
from . import filters as flt
from .names import NameIndex
from .postings import TextIndex

MISSING = 999999
#: Queries of a block, and chunks of a batch, whose scores are held at once: 8 MB of them.
QUERY_ROWS, CHUNK_ROWS = 512, 2048


def of_model(chunks: DataFrame, model: str | None) -> DataFrame:
    return chunks if model is None else chunks.filter(F.col("embedding_model") == model)


def scored(chunks: DataFrame, query: Sequence[float]) -> DataFrame:
    return chunks.withColumn("similarity", F.round(vec.cosine(F.col("embedding"), vec.literal(query)), 6))


def nearest(chunks: DataFrame, query: Sequence[float], n: int, *carry: str) -> DataFrame:
    """chunk_id, doc_id, similarity and what is carried: the n most similar chunks.

    Vectors that are null, zero, or hold null or non-finite components take no part, as in batches.
    """
    s = scored(chunks, query).filter(F.col("similarity").isNotNull() & ~F.isnan("similarity"))
    return s.select("chunk_id", "doc_id", "similarity", *carry).orderBy(F.desc("similarity"), "chunk_id").limit(n)


def ranked(df: DataFrame, score: str, name: str) -> DataFrame:
    """Ranks of the few rows that a limit left."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(F.desc(score), "chunk_id")).cast("long"))


def kept(df: DataFrame) -> DataFrame:
    """The few rows that a limit left, as a local table: what is derived from them does not scan the chunks again."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def best(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order, "chunk_id").limit(k)


def ner_score(n: Column) -> Column:
    """I8: 0 for none, 1 from ten on, logarithmic between."""
    return F.least(F.lit(1.0), F.log(F.lit(1.0) + F.coalesce(n, F.lit(0))) / F.log(F.lit(11.0)))


def mention_counts(candidates: DataFrame, mentions: DataFrame) -> DataFrame:
    """Each candidate chunk's mentions, those of its document and section (null sections have none).

    Candidates are few (a limit): their documents are named in the scan's filter, and mentions meet
    their keys by a semi join before they are grouped.
    """
    key = ["doc_id", "section_name"]
    documents = [r.doc_id for r in candidates.select("doc_id").distinct().collect()]
    near = mentions.filter(F.col("doc_id").isin(documents)).join(F.broadcast(candidates.select(key).distinct()), key, "left_semi")
    counts = near.groupBy(key).agg(F.count(F.lit(1)).alias("mention_count"), F.array_sort(F.collect_set("label")).alias("entity_types"))
    out = candidates.join(counts, key, "left")
    return out.withColumn("mention_count", F.coalesce("mention_count", F.lit(0).cast("long"))).withColumn("entity_types", F.coalesce("entity_types", F.array().cast("array<string>")))


def vector_only(chunks: DataFrame, query: Sequence[float], k: int = 10, model: str | None = None) -> DataFrame:
    """G1: strategy 1."""
    return nearest(of_model(chunks, model), query, k).withColumn("final_score", F.col("similarity"))


def ner_boost(chunks: DataFrame, mentions: DataFrame, query: Sequence[float], k: int = 10, model: str | None = None, weight: float = 0.15, multiplier: int = 3) -> DataFrame:
    """Strategy 2, the nearest multiplier * k boosted by their mentions."""
    return boosted(kept(nearest(of_model(chunks, model), query, multiplier * k, "section_name")), mentions, k, weight)


def boosted(near: DataFrame, mentions: DataFrame, k: int, weight: float = 0.15) -> DataFrame:
    """Strategy 2 over the nearest."""
    c = mention_counts(near, mentions)
    c = c.withColumn("boost", F.round(F.lit(weight) * ner_score(F.col("mention_count")), 6))
    c = c.withColumn("final_score", F.round(F.col("similarity") + F.col("boost"), 6))
    return best(c, k, F.desc("final_score"), F.desc("similarity")).drop("section_name")


def text_matches(chunks: DataFrame, query: str, n: int, mode: str = "and", *carry: str, rank: str = "words", index: TextIndex | None = None, model: str | None = None) -> DataFrame:
    """The n chunks that match best, by the share of their words (rank="words") or by stems and positions ("stems").

    With an index (of these chunks, carrying doc_id, what is carried here and, for `model`,
    embedding_model; its analyzer ranks) only the query's lists are read; without one, all texts are.
    """
    if index is not None:
        return index.search(query, n, mode, None if model is None else F.col("embedding_model") == model).select("chunk_id", "doc_id", "text_score", *carry)
    if rank == "stems":
        s = fulltext.scored(chunks, query, mode=mode).withColumn("text_score", F.round("text_score", 8))
        return s.select("chunk_id", "doc_id", "text_score", *carry).orderBy(F.desc("text_score"), "chunk_id").limit(n)
    q = tx.query_terms(query)
    words = tx.terms(F.col("text"))
    c = chunks.filter(tx.matches(words, q, mode)).withColumn("text_score", F.round(tx.term_score(words, q), 6))
    return c.select("chunk_id", "doc_id", "text_score", *carry).orderBy(F.desc("text_score"), "chunk_id").limit(n)


def candidates(chunks: DataFrame, query: Sequence[float], words: str, n: int, mode: str, rank: str = "words", index: TextIndex | None = None, model: str | None = None) -> DataFrame:
    """The nearest and the best matches with both ranks; a match that is not near has similarity 0. At most 2 n rows, scanned for once."""
    v = nearest(chunks, query, n, "section_name")
    return fused_candidates(v, text_matches(chunks, words, n, mode, "section_name", rank=rank, index=index, model=model))


def fused_candidates(near: DataFrame, matching: DataFrame) -> DataFrame:
    v, t = ranked(near, "similarity", "vector_rank"), ranked(matching, "text_score", "text_rank")
    j = v.alias("v").join(t.alias("t"), "chunk_id", "full_outer")
    return kept(j.select("chunk_id", F.coalesce("v.doc_id", "t.doc_id").alias("doc_id"), F.coalesce("v.section_name", "t.section_name").alias("section_name"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"), "text_score", "vector_rank", "text_rank"))


def hybrid_rrf(chunks: DataFrame, query: Sequence[float], words: str, k: int = 10, model: str | None = None, rrf_k: int = 60, mode: str = "and", multiplier: int = 3, rank: str = "words", index: TextIndex | None = None) -> DataFrame:
    """Strategy 3, reciprocal rank fusion."""
    return fused_by_rank(candidates(of_model(chunks, model), query, words, multiplier * k, mode, rank, index, model), k, multiplier * k, rrf_k)


def fused_by_rank(c: DataFrame, k: int, n: int, rrf_k: int = 60) -> DataFrame:
    part = lambda r: F.lit(1.0) / (F.lit(float(rrf_k)) + F.coalesce(r, F.lit(n + 1)))
    c = c.withColumn("final_score", F.round(part(F.col("vector_rank")) + part(F.col("text_rank")), 8))
    return best(c, k, F.desc("final_score")).drop("section_name")


def _norm_text(c: DataFrame) -> DataFrame:
    """The text score by the largest; 0 where there is none."""
    top = F.max("text_score").over(Window.partitionBy())
    return c.withColumn("norm_text", F.coalesce(F.try_divide(F.col("text_score"), F.when(top > 0, top)), F.lit(0.0)))


def hybrid_weighted(chunks: DataFrame, query: Sequence[float], words: str, k: int = 10, model: str | None = None, weights=(0.7, 0.3), mode: str = "and", multiplier: int = 3, rank: str = "words", index: TextIndex | None = None) -> DataFrame:
    """Strategy 3 by weights; without a match the vector part stands alone."""
    c = _norm_text(candidates(of_model(chunks, model), query, words, multiplier * k, mode, rank, index, model))
    c = c.withColumn("final_score", F.round(weights[0] * F.col("similarity") + weights[1] * F.col("norm_text"), 6))
    for r in ("vector_rank", "text_rank"):
        c = c.withColumn(r, F.coalesce(r, F.lit(MISSING).cast("long")))
    return best(c, k, F.desc("final_score")).drop("section_name", "norm_text")


def full_hybrid(chunks: DataFrame, mentions: DataFrame, query: Sequence[float], words: str, k: int = 10, model: str | None = None, weights=(0.5, 0.3, 0.2), mode: str = "and", multiplier: int = 3, rank: str = "words", index: TextIndex | None = None) -> DataFrame:
    """Strategy 4, vector, text and mentions."""
    return fused_fully(candidates(of_model(chunks, model), query, words, multiplier * k, mode, rank, index, model), mentions, k, weights)


def fused_fully(c: DataFrame, mentions: DataFrame, k: int, weights=(0.5, 0.3, 0.2)) -> DataFrame:
    c = mention_counts(_norm_text(c), mentions)
    c = c.withColumn("ner", ner_score(F.col("mention_count")))
    c = c.withColumn("final_score", F.round(weights[0] * F.col("similarity") + weights[1] * F.col("norm_text") + weights[2] * F.col("ner"), 6))
    for r in ("vector_rank", "text_rank"):
        c = c.withColumn(r, F.coalesce(r, F.lit(MISSING).cast("long")))
    return best(c, k, F.desc("final_score")).drop("section_name", "norm_text", "ner")


# The strategies' names.
STRATEGIES = ("ivfflat_only", "ivfflat_ner_boost", "ivfflat_tsvector", "ivfflat_ner_tsvector")


def search(strategy: str, chunks: DataFrame, mentions: DataFrame, query: Sequence[float], words: str, k: int = 10, **more) -> DataFrame:
    """The strategy by name; an unknown name is the first."""
    if strategy == "ivfflat_ner_boost":
        return ner_boost(chunks, mentions, query, k, **more)
    if strategy == "ivfflat_tsvector":
        return hybrid_rrf(chunks, query, words, k, **more)
    if strategy == "ivfflat_ner_tsvector":
        return full_hybrid(chunks, mentions, query, words, k, **more)
    return vector_only(chunks, query, k, **more)


def compare(chunks: DataFrame, mentions: DataFrame, query: Sequence[float], words: str, k: int = 10, rank: str = "words", index: TextIndex | None = None, model: str | None = None) -> DataFrame:
    """Strategy, position, chunk_id, final_score of all four, from one search by vector and one by text."""
    n = 3 * k
    chunks = of_model(chunks, model)
    near = kept(nearest(chunks, query, n, "section_name"))
    c = fused_candidates(near, text_matches(chunks, words, n, "and", "section_name", rank=rank, index=index, model=model))
    found = (best(near, k, F.desc("similarity")).withColumn("final_score", F.col("similarity")), boosted(near, mentions, k), fused_by_rank(c, k, n), fused_fully(c, mentions, k))
    parts = []
    for name, r in zip(STRATEGIES, found, strict=True):
        order = [F.desc("final_score")] + ([F.desc("similarity")] if name == "ivfflat_ner_boost" else [])
        parts.append(r.select(F.lit(name).alias("strategy"), F.row_number().over(Window.orderBy(*order, "chunk_id")).cast("long").alias("position"), "chunk_id", "final_score"))
    return reduce(DataFrame.unionByName, parts)


def filtered(chunks: DataFrame, docs: DataFrame, query: Sequence[float], f: flt.Filters, k: int = 5, model: str | None = None, names: NameIndex | None = None) -> DataFrame:
    """Exact search among the chunks of documents that pass the filters, which reach the scan first.

    With an index of names the documents that its names rule out are not checked.
    """
    pool = docs if names is None else names.candidates(docs, f)
    kept = pool.filter(flt.build(f)).select("doc_id")
    return nearest(of_model(chunks, model).join(kept, "doc_id", "left_semi"), query, k).withColumn("final_score", F.col("similarity"))


def contexts(hits: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """The hits with their text and metadata; joined after the limit, whose ids the scans filter by."""
    few = kept(hits)  # k rows, k is a limit
    ids = few.select("chunk_id", "doc_id").collect()
    c = chunks.filter(F.col("chunk_id").isin([r.chunk_id for r in ids])).select("chunk_id", "chunk_index", "text").join(F.broadcast(few), "chunk_id")
    d = docs.filter(F.col("doc_id").isin(sorted({r.doc_id for r in ids}))).select("doc_id", doc_ref(F.col("ext_id")).alias("doc_ref"), "title", F.coalesce("source", F.lit("UNKNOWN")).alias("source"), F.col("author").alias("authors"), F.year("year").alias("year"), F.col("institute").alias("institution"))
    return d.join(F.broadcast(c), "doc_id").withColumn("distance", F.round(1 - F.col("similarity"), 6))


def l2_nearest(chunks: DataFrame, query: Sequence[float], k: int = 10) -> DataFrame:
    """G4."""
    d = chunks.withColumn("distance", F.round(vec.l2_distance(F.col("embedding"), vec.literal(query)), 6))
    return d.select("chunk_id", "distance").orderBy("distance", "chunk_id").limit(k)


def similar_mentions(mentions: DataFrame, embeddings: DataFrame, query: Sequence[float], label: str | None = None, k: int = 10) -> DataFrame:
    """G11, D7."""
    m = mentions if label is None else mentions.filter(F.col("label") == label)
    s = m.join(embeddings, "mention_id").withColumn("similarity", F.round(vec.cosine(F.col("embedding"), vec.literal(query)), 6))
    return s.select("mention_id", "doc_id", "mention_text", "label", "similarity").orderBy(F.desc("similarity"), "mention_id").limit(k)


def mentions_of_document(mentions: DataFrame, doc_id: int) -> DataFrame:
    """G12."""
    return mentions.filter(F.col("doc_id") == doc_id).orderBy("start_char", "mention_id")


def mentions_by_label(mentions: DataFrame, label: str, limit: int = 100) -> DataFrame:
    """G13, C12."""
    return mentions.filter(F.col("label") == label).orderBy(F.desc("created_at"), "mention_id").limit(limit)


def best_places(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k largest scores, ties by the smaller id."""
    order = np.lexsort((ids, -scores, query))
    begin = np.flatnonzero(np.diff(query[order], prepend=-1))
    place = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    return order[place < k]


def unit_rows(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have a direction (finite, not zero), by their norms, and their places."""
    norms = np.sqrt(np.einsum("ij,ij->i", v, v))
    good = np.flatnonzero(np.isfinite(norms) & (norms > 0))
    return v[good] / norms[good, None], good


class BestOf:
    """Each query's k most similar chunks so far: fed with batches of chunks, holds k a query and what may still pass them.

    Products of single precision, with a bound of their error, rule out what a query's k-th best so far
    exceeds; the rest is multiplied in double precision.
    """

    def __init__(self, names: np.ndarray, vectors: np.ndarray, k: int):
        self.names, self.m, self.k = names, vectors, k
        self.single, self.slack = vectors.astype(np.float32), 1e-6 + (vectors.shape[-1] + 8) * 2.0**-23
        starts = range(0, len(names), QUERY_ROWS)
        self.held = [[np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)] for _ in starts]
        self.least = [np.full(len(vectors[s : s + QUERY_ROWS]), -np.inf) for s in starts]
        self.waiting = [[] for _ in starts]

    def feed(self, c: np.ndarray, v: np.ndarray) -> None:
        for s in range(0, len(c), CHUNK_ROWS):
            self._feed(c[s : s + CHUNK_ROWS], v[s : s + CHUNK_ROWS])

    def _feed(self, c: np.ndarray, v: np.ndarray) -> None:
        v, good = unit_rows(v)
        c, k, single = c[good], self.k, v.T.astype(np.float32)
        for at, start in enumerate(range(0, len(self.names), QUERY_ROWS) if len(c) else ()):
            s = self.single[start : start + QUERY_ROWS] @ single
            least = self.least[at] - self.slack
            if len(c) > k and np.isneginf(least).any():
                least = np.maximum(least, np.partition(s, len(c) - k, axis=1)[:, len(c) - k] - 2 * self.slack)
            i, j = np.divmod(np.flatnonzero(s >= least.astype(np.float32)[:, None]), len(c))
            if not len(i):
                continue
            self.waiting[at].append((i + start, c[j], np.round(np.einsum("ij,ij->i", self.m[i + start], v[j]), 6)))
            if sum(len(w[0]) for w in self.waiting[at]) >= 4 * len(s) or np.isneginf(self.least[at]).any():
                self._settle(at)

    def _settle(self, at: int) -> None:
        """The waiting ones among the k best, whose last is what others must reach."""
        both = [np.concatenate(x) for x in zip(self.held[at], *self.waiting[at], strict=True)]
        self.waiting[at] = []
        if len(both[0]):
            first = best_places(*both, self.k)
            self.held[at] = q, _, s = [x[first] for x in both]
            full = np.flatnonzero(np.bincount(q - at * QUERY_ROWS, minlength=len(self.least[at])) == self.k)
            lowest = np.full(len(self.least[at]), np.inf)
            np.minimum.at(lowest, q - at * QUERY_ROWS, s)
            self.least[at][full] = lowest[full]

    def found(self) -> pa.RecordBatch:
        for at in range(len(self.held)):
            self._settle(at)
        q, c, s = (np.concatenate([h[i] for h in self.held] or [np.zeros(0)]) for i in range(3))
        return pa.RecordBatch.from_arrays([pa.array(self.names[q.astype(np.int64)], pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "chunk_id", "similarity"])


class BestOfParts:
    """BestOf by each of several parts of the dimensions, which read the chunks together; `part` numbers them."""

    def __init__(self, names: np.ndarray, vectors: np.ndarray, k: int, parts: Sequence[Sequence[int]]):
        self.parts, self.best = [np.asarray(p) for p in parts], []
        for p in self.parts:
            m, good = unit_rows(vectors[:, p])
            self.best.append(BestOf(names[good], m, k))

    def feed(self, c: np.ndarray, v: np.ndarray) -> None:
        for p, best in zip(self.parts, self.best, strict=True):
            best.feed(c, v[:, p])

    def found_by_part(self) -> list[pa.RecordBatch]:
        return [b.found() for b in self.best]

    def found(self) -> pa.RecordBatch:
        out = self.found_by_part()
        part = pa.array(np.repeat(np.arange(len(out), dtype=np.int32), [b.num_rows for b in out]))
        return pa.Table.from_batches(out).combine_chunks().append_column("part", part).to_batches()[0] if len(part) else _no_parts()


def _no_parts() -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.int32())], names=["query_id", "chunk_id", "similarity", "part"])


FOUND = "query_id long, chunk_id long, similarity double"
FOUND_PARTS = f"{FOUND}, part int"


def rows_of(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def whole(vector: str) -> Column:
    """Not null, not empty, no null component."""
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull())


def few_nearest(chunks: DataFrame, names: np.ndarray, vectors: np.ndarray, k: int, parts: Sequence[Sequence[int]] | None = None) -> DataFrame:
    """query_id, chunk_id, similarity (and part): each task's k best chunks of each of a checked number of queries, which are broadcast."""
    shared = chunks.sparkSession.sparkContext.broadcast((names, vectors))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = BestOf(*shared.value, k) if parts is None else BestOfParts(*shared.value, k, parts)
        for b in batches:
            best.feed(b.column("chunk_id").to_numpy(), rows_of(b.column("embedding"), b.num_rows))
        yield best.found()

    good = chunks.filter(whole("embedding") & (F.size("embedding") == vectors.shape[1]))
    return good.select("chunk_id", vec.as_double("embedding").alias("embedding")).mapInArrow(each, FOUND if parts is None else FOUND_PARTS)


def tiles_nearest(chunks: DataFrame, queries: DataFrame, keys: list[str], k: int, parts: Sequence[Sequence[int]] | None = None) -> DataFrame:
    """query_id, chunk_id, similarity (and part): the k best of each query within each tile.

    A tile is the chunks (keys, chunk_id, embedding) and queries (keys, query_id, vector) of equal
    keys and vector length; whoever deals them bounds its size. Nothing is broadcast or collected.
    """
    none = F.lit(None).cast("long")
    c = chunks.filter(whole("embedding")).select(*keys, none.alias("query_id"), F.col("chunk_id").cast("long").alias("chunk_id"), vec.as_double("embedding").alias("v"))
    q = queries.filter(whole("vector")).select(*keys, F.col("query_id").cast("long").alias("query_id"), none.alias("chunk_id"), vec.as_double("vector").alias("v"))

    def tile(group: pa.Table) -> pa.Table:
        asked = group.column("query_id").is_valid().to_numpy()
        x = rows_of(group.column("v"), group.num_rows)
        names, ids = group.column("query_id").to_pandas().to_numpy(), group.column("chunk_id").to_pandas().to_numpy()
        m, good = unit_rows(x[asked])
        named = names[asked][good].astype(np.int64)
        best = BestOf(named, m, k) if parts is None else BestOfParts(named, m, k, parts)
        rows = np.flatnonzero(~asked)
        for s in range(0, len(rows), CHUNK_ROWS):
            best.feed(ids[rows[s : s + CHUNK_ROWS]].astype(np.int64), x[rows[s : s + CHUNK_ROWS]])
        return pa.Table.from_batches([best.found()])

    return q.unionByName(c).withColumn("_size", F.size("v")).groupBy(*keys, "_size").applyInArrow(tile, FOUND if parts is None else FOUND_PARTS)


def grid_nearest(chunks: DataFrame, queries: DataFrame, k: int, query_rows: int = 16_384, chunk_rows: int = 65_536, parts: Sequence[Sequence[int]] | None = None) -> DataFrame:
    """query_id, chunk_id, similarity (and part), of any number of queries: both sides are dealt to blocks, each pair of blocks is a tile.

    The shuffle carries each chunk once a block of queries and each query once a block of chunks.
    """
    blocks = [max(1, -(-df.count() // rows)) for df, rows in ((queries, query_rows), (chunks, chunk_rows))]
    own = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("query_id", "vector", own("query_id", blocks[0]).alias("_i"), every(blocks[1]).alias("_j"))
    c = chunks.select("chunk_id", "embedding", every(blocks[0]).alias("_i"), own("chunk_id", blocks[1]).alias("_j"))
    return tiles_nearest(c, q, ["_i", "_j"], k, parts)


def best_by_query(found: DataFrame, k: int, *more: str) -> DataFrame:
    """query_id, rank, chunk_id, similarity: each query's (and each value's of `more`) k best of what tasks have found."""
    place = F.row_number().over(Window.partitionBy(*more, "query_id").orderBy(F.desc("similarity"), "chunk_id"))
    return found.withColumn("rank", place.cast("long")).filter(F.col("rank") <= k)


#: Queries of a tile that is searched by many parts of the dimensions.
PARTS_QUERIES = 4096


def blocks_of_parts(chunks: DataFrame, queries: DataFrame, k: int, parts: Sequence[Sequence[int]], finish: Callable[[list[pa.RecordBatch]], pa.RecordBatch], schema: str, dim: int, query_rows: int = PARTS_QUERIES) -> DataFrame:
    """What `finish` makes of each block of queries: it gets their k best (query_id, chunk_id, similarity) by each of the parts.

    A task gets a block's queries, then all chunks batch by batch, so what it holds does not grow with the
    chunks, and nothing found is shuffled. The shuffle carries each chunk once a block. Any number of queries;
    vectors of both sides that are not of length `dim`, null, zero, or hold null or non-finite components take no part.
    """
    good = lambda df, v: df.filter(whole(v) & (F.size(v) == dim))
    asked, cores = good(queries, "vector"), chunks.sparkSession.sparkContext.defaultParallelism
    rows = max(1, asked.count())
    n = -(-rows // query_rows)
    n = max(n, min(-(-n // cores) * cores, -(-rows // QUERY_ROWS)))  # each core gets as many, unless blocks get too small for that
    q = asked.select(F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int").alias("block"), F.lit(False).alias("is_chunk"), F.col("query_id").cast("long").alias("id"), F.col("vector").alias("v"))
    c = good(chunks, "embedding").select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), F.lit(True).alias("is_chunk"), F.col("chunk_id").cast("long").alias("id"), F.col("embedding").alias("v"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, names, vectors, best = None, [], [], None

        def search() -> BestOfParts:
            return best or BestOfParts(np.concatenate(names), np.concatenate(vectors), k, parts)

        for b in batches:
            of, is_chunk, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            x = rows_of(b.column(3), b.num_rows).astype(float)
            for at in np.unique(of):
                if at != block:
                    if names:
                        yield finish(search().found_by_part())
                    block, names, vectors, best = at, [], [], None
                mine, others = (np.flatnonzero((of == at) & side) for side in (~is_chunk, is_chunk))
                if len(mine):
                    names.append(ids[mine])
                    vectors.append(x[mine])
                if len(others) and names:
                    best = search()
                    best.feed(ids[others], x[others])
        if names:
            yield finish(search().found_by_part())

    dealt = q.unionByName(c).repartitionById(n, F.col("block")).sortWithinPartitions("block", "is_chunk")
    return dealt.mapInArrow(each, schema)


def batch_nearest(chunks: DataFrame, queries: DataFrame, k: int = 10, most_queries: int = 10_000, parts: Sequence[Sequence[int]] | None = None) -> DataFrame:
    """query_id, rank, chunk_id, similarity: top k of any number of queries (query_id, vector), one plan.

    Up to most_queries of them (counted) of one vector length are broadcast: a pass over the chunks,
    whose tasks keep k a query. More go through the grid of blocks, whose driver holds nothing.
    Vectors on either side that are null, zero, or hold null or non-finite components take no part.
    With `parts` (lists of dimensions, few) also `part`: the top k by the dimensions of each list,
    all in the same pass.
    """
    q = queries.filter(whole("vector")).select("query_id", vec.as_double("vector").alias("vector"))
    more = [] if parts is None else ["part"]
    first = q.limit(most_queries + 1).toArrow()
    sizes = set(first.column("vector").combine_chunks().value_lengths().to_pylist()) if first.num_rows else {1 if parts is None else 1 + max(map(max, parts))}
    if first.num_rows > most_queries or len(sizes) > 1:
        return best_by_query(grid_nearest(chunks, q, k) if parts is None else grid_nearest(chunks, q, k, PARTS_QUERIES, parts=parts), k, *more)
    x = rows_of(first.column("vector"), first.num_rows) if first.num_rows else np.zeros((0, *sizes))
    m, good = unit_rows(x)
    return best_by_query(few_nearest(chunks, first.column("query_id").to_numpy()[good], m, k, parts), k, *more)


def batch_filtered(chunks: DataFrame, docs: DataFrame, queries: DataFrame, f: flt.Filters, k: int = 5) -> DataFrame:
    """G10 for many queries (query_id, vector) under one filter: only the chunks of documents that pass are multiplied."""
    return batch_nearest(chunks.join(docs.filter(flt.build(f)).select("doc_id"), "doc_id", "left_semi"), queries, k)


def batch_boost(chunks: DataFrame, mentions: DataFrame, queries: DataFrame, k: int = 10, weight: float = 0.15, multiplier: int = 3, near: DataFrame | None = None) -> DataFrame:
    """Strategy 2 for many queries (query_id, vector): the nearest multiplier * k of each (`near` if the caller has them), boosted by their mentions."""
    near = batch_nearest(chunks, queries, multiplier * k) if near is None else near
    c = with_mention_counts(near.drop("rank"), chunks, mentions)
    c = c.withColumn("final_score", F.round(F.col("similarity") + F.round(F.lit(weight) * ner_score(F.col("mention_count")), 6), 6))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final_score"), F.desc("similarity"), "chunk_id"))
    return c.withColumn("rank", place.cast("long")).filter(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "similarity", "mention_count", "final_score")


def with_mention_counts(found: DataFrame, chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    """`found` (with chunk_id) with its chunks' document, section and mention_count; mentions of these alone are counted."""
    c, key = found.join(chunks.select("chunk_id", "doc_id", "section_name"), "chunk_id"), ["doc_id", "section_name"]
    counts = mentions.join(c.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("mention_count"))
    return c.join(counts, key, "left").withColumn("mention_count", F.coalesce("mention_count", F.lit(0).cast("long")))


def batch_matches(chunks: DataFrame, queries: DataFrame, n: int, mode: str = "and", rank: str = "words", index: TextIndex | None = None) -> DataFrame:
    """query_id, chunk_id, text_score, text_rank: the n best matches of many queries (query_id, words) in one join on terms.

    Only the queries' terms leave the chunks: those are counted a chunk before anything is shuffled.
    With rank="stems" the terms are stems, and a chunk that has them is ranked by their positions.
    With an index of the chunks only its postings are read.
    """
    if index is not None:
        return index.batch(queries, n, mode)
    if rank == "stems":
        return fulltext.batch_scored(chunks, queries, n, mode)
    first = F.slice(F.split(tx.strip(F.col("words")), r"\s+"), 1, 10)
    asked = queries.select("query_id", F.array_distinct(tx.terms(F.array_join(first, " "))).alias("asked"))
    asked = asked.select("query_id", F.size("asked").alias("n_asked"), F.explode("asked").alias("term"))
    words = chunks.select("chunk_id", tx.terms(F.col("text")).alias("w"))
    known = asked.select("term").distinct()
    tf = words.select("chunk_id", F.size("w").alias("n_words"), F.explode("w").alias("term")).join(known, "term", "left_semi")
    tf = tf.groupBy("chunk_id", "n_words", "term").agg(F.count(F.lit(1)).alias("tf"))
    hits = tf.join(asked, "term").groupBy("query_id", "chunk_id", "n_words", "n_asked").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("found"))
    hits = hits if mode == "or" else hits.filter("found = n_asked")
    hits = hits.withColumn("text_score", F.round(F.col("tf").cast("double") / F.col("n_words"), 6))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("text_score"), "chunk_id"))
    return hits.withColumn("text_rank", rank.cast("long")).filter(F.col("text_rank") <= n).select("query_id", "chunk_id", "text_score", "text_rank")


def batch_hybrid(chunks: DataFrame, mentions: DataFrame, queries: DataFrame, k: int = 10, fusion: str = "rrf", mode: str = "and", rrf_k: int = 60, weights=(0.5, 0.3, 0.2), multiplier: int = 3, rank: str = "words", index: TextIndex | None = None, near: DataFrame | None = None, matching: DataFrame | None = None) -> DataFrame:
    """Strategies 3 (fusion="rrf") and 4 ("weighted") for many queries (query_id, vector, words) in one plan.

    Candidates carry ids and scores; the chunks' document and section, and mentions of these alone,
    are joined to them afterwards. `near` and `matching` are the multiplier * k nearest and best
    matches of each query, if the caller has them.
    """
    n = multiplier * k
    v = (batch_nearest(chunks, queries, n) if near is None else near).withColumnRenamed("rank", "vector_rank")
    matching = batch_matches(chunks, queries, n, mode, rank, index) if matching is None else matching
    c = v.join(matching, ["query_id", "chunk_id"], "full_outer").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    if fusion == "rrf":
        part = lambda r: F.lit(1.0) / (F.lit(float(rrf_k)) + F.coalesce(F.col(r), F.lit(n + 1)))
        c = c.withColumn("final_score", F.round(part("vector_rank") + part("text_rank"), 8))
    else:
        top = F.max("text_score").over(Window.partitionBy("query_id"))
        norm = F.coalesce(F.try_divide(F.col("text_score"), F.when(top > 0, top)), F.lit(0.0))
        c = with_mention_counts(c.withColumn("norm", norm), chunks, mentions)
        c = c.withColumn("final_score", F.round(weights[0] * F.col("similarity") + weights[1] * F.col("norm") + weights[2] * ner_score(F.col("mention_count")), 6))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final_score"), "chunk_id"))
    c = c.withColumn("rank", place.cast("long")).filter(F.col("rank") <= k)
    return c.select("query_id", "rank", "chunk_id", "similarity", "text_score", "final_score")


def self_neighbours(vectors: DataFrame, k: int = 10, most: int = 10_000, every: int = 1, parts: Sequence[Sequence[int]] | None = None) -> DataFrame:
    """The k nearest others, among all vectors, of each whose id divides by `every` (by each of `parts`); beyond `most` queries by the grid."""
    queries = vectors.filter(F.col("chunk_id") % every == 0).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = batch_nearest(vectors, queries, k + 1, most, parts)
    return best_by_query(found.filter("query_id <> chunk_id"), k, *([] if parts is None else ["part"]))
