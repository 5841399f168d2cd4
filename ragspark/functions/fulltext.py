"""Full text with English stems (I4-I7, B7): vectors of lexemes with positions, queries, match, rank.

The rank is the common one of lexeme vectors with all weights 0.1: of one lexeme, its occurrences
count 1/j**2; of several that must all occur, each pair counts by its distance. Texts are handled in
Arrow batches, since stemming is a program, not an expression; operators/postings.py does so once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .english import lexemes, stem

__all__ = ["batch_scored", "lexemes", "matches", "query_lexemes", "rank", "scored", "stem", "with_vector"]
WEIGHT = 0.1


def query_lexemes(query: str, most: int = 10) -> list[str]:
    """Of the first words; safe for any signs in them."""
    return list(lexemes(" ".join(query.split()[:most])))


def matches(vector: dict, query: list[str], mode: str = "and") -> bool:
    hits = [q in vector for q in query]
    return bool(query) and (all(hits) if mode == "and" else any(hits))


def _pair(a: np.ndarray, b: np.ndarray) -> float:
    """The logarithm of what all pairs of two lexemes' positions leave of 1; a lexeme has at most 256 positions."""
    apart = np.abs(np.subtract.outer(a, b)).ravel()
    apart = apart[(apart > 0) & (apart <= 100)]  # farther ones count 1e-30, one place holds one word
    return float(np.log1p(-WEIGHT / np.sqrt(1.005 + 0.05 * np.exp(apart / 1.5 - 2))).sum())


def rank(vector: dict[str, list[int]], query: list[str], mode: str = "and") -> float:
    """I7."""
    there = [np.asarray(vector[q], float) for q in query if q in vector]
    if not query or not there:
        return 0.0
    if mode == "and" and len(query) > 1:
        return float(-np.expm1(sum(_pair(a, b) for i, a in enumerate(there) for b in there[i + 1 :])))
    return sum(float((WEIGHT / np.arange(1, len(p) + 1) ** 2).sum()) / 1.64493406685 for p in there) / len(query)


def with_vector(df: DataFrame, text: str = "text", out: str = "text_tsv") -> DataFrame:
    """The derived column array<struct<lexeme, positions>>, by lexeme."""

    @F.pandas_udf("array<struct<lexeme:string,positions:array<int>>>")
    def vector(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([[{"lexeme": k, "positions": p} for k, p in sorted(lexemes(t).items())] for t in s])

    return df.withColumn(out, vector(text))


def scored(df: DataFrame, query: str, text: str = "text", mode: str = "and", out: str = "text_score") -> DataFrame:
    """The rows that match, with their rank."""
    q = query_lexemes(query)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([rank(v, q, mode) if matches(v := lexemes(t), q, mode) else None for t in s], dtype="float64")

    got: Column = F.nanvl(score(text), F.lit(None).cast("double"))
    return df.withColumn(out, got).filter(F.col(out).isNotNull())


def batch_scored(df: DataFrame, queries: DataFrame, n: int, mode: str = "and") -> DataFrame:
    """query_id, chunk_id, text_score, text_rank: the n best of many queries (query_id, words), by stems and positions.

    The chunks' stems are made once and exploded, and only those that a query asks for go on, with
    their positions; what a query's stems find in a chunk is then ranked as one vector.
    """

    @F.pandas_udf("array<string>")
    def asked_stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([query_lexemes(t or "") for t in s])

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for found, asked in batches:
            yield pd.Series([rank({x["lexeme"]: list(x["positions"]) for x in v}, list(q), mode) for v, q in zip(found, asked, strict=True)], dtype="float64")

    asked = queries.select("query_id", asked_stems("words").alias("asked"))
    one = asked.select("query_id", "asked", F.explode("asked").alias("lexeme"))
    words = with_vector(df.select("chunk_id", "text")).select("chunk_id", F.inline("text_tsv")).join(one.select("lexeme").distinct(), "lexeme", "left_semi")
    hits = words.join(one, "lexeme").groupBy("query_id", "chunk_id", "asked").agg(F.array_sort(F.collect_list(F.struct("lexeme", "positions"))).alias("found"))
    hits = hits if mode == "or" else hits.filter(F.size("found") == F.size("asked"))
    hits = hits.select("query_id", "chunk_id", F.round(score("found", "asked"), 8).alias("text_score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("text_score"), "chunk_id"))
    return hits.withColumn("text_rank", place.cast("long")).filter(F.col("text_rank") <= n)
