"""Many questions to answers in one plan (D13, I35-I37): nearest passages, prompts, a generator in batches, citations as joins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import citations, doc_ref
from ..plug import SYSTEM_PROMPT, USER_PROMPT, Generator
from ..session import own_folder
from . import filters as flt
from .retrieval import batch_nearest, of_model

#: Passages of a question, at most.
MOST_PASSAGES = 15


def passages(questions: DataFrame, chunks: DataFrame, docs: DataFrame, k: int = 5, where: flt.Filters | None = None, model: str | None = None) -> DataFrame:
    """query_id, rank, chunk_id, similarity, doc_ref, chunk_index, text: each question's (query_id, vector) k nearest chunks of documents that pass."""
    if not 1 <= k <= MOST_PASSAGES:
        raise ValueError(f"k is from 1 to {MOST_PASSAGES}")
    pool = of_model(chunks, model)
    if where is not None:
        pool = pool.join(docs.filter(flt.build(where)).select("doc_id"), "doc_id", "left_semi")
    # Ranks are stored once: prompts and citations both start from them, texts are joined to them each time.
    place = f"{own_folder(chunks.sparkSession, 'passages')}/ranks"
    batch_nearest(pool, questions.select("query_id", "vector"), k).write.parquet(place)
    ranks = chunks.sparkSession.read.schema("query_id long, chunk_id long, similarity double, rank long").parquet(place)
    found = ranks.join(chunks.select("chunk_id", "doc_id", "chunk_index", "text"), "chunk_id")
    return found.join(docs.select("doc_id", doc_ref(F.col("ext_id")).alias("doc_ref")), "doc_id").drop("doc_id")


def generated(questions: DataFrame, hits: DataFrame, generator: Generator) -> DataFrame:
    """query_id, question, n_contexts, answer; the generator goes to each worker once and gets a batch of prompts at a time, if it takes many.

    A question without passages has no answer.
    """
    line = F.concat(F.lit("["), "doc_ref", F.lit("#"), F.col("chunk_index").cast("string"), F.lit("] "), F.coalesce("text", F.lit("")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])
    context = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_contexts"), F.array_join(listed, "\n\n").alias("context"))
    asked = questions.select("query_id", "question").join(context, "query_id", "left").withColumn("n_contexts", F.coalesce("n_contexts", F.lit(0).cast("long")))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        many = getattr(generator, "generate_many", None)
        for b in batches:
            prompts = [None if c is None else USER_PROMPT.format(context=c, question=q or "") for c, q in zip(b.context, b.question, strict=True)]
            some = [p for p in prompts if p is not None]
            told = iter(many(SYSTEM_PROMPT, some) if many else [generator.generate(SYSTEM_PROMPT, p) for p in some])
            yield b.drop(columns="context").assign(answer=[None if p is None else next(told) for p in prompts])

    return asked.select("query_id", "question", "n_contexts", "context").mapInPandas(each, "query_id long, question string, n_contexts long, answer string")


def cited(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, position, chunk_id, doc_ref, chunk_index: the passages that each answer cites, in order; if it cites none of them, the first.

    Citations meet the question's passages by document and chunk, those of other passages go.
    """
    named = answers.select("query_id", F.posexplode(citations(F.col("answer"))).alias("position", "c")).select("query_id", "position", F.col("c.doc").alias("doc_ref"), F.col("c.idx").alias("chunk_index"))
    slim = hits.select("query_id", "rank", "chunk_id", "doc_ref", "chunk_index")
    found = named.join(slim.withColumn("chunk_index", F.col("chunk_index").cast("int")), ["query_id", "doc_ref", "chunk_index"])
    ordinal = F.row_number().over(_by_query("position", "rank")).cast("long")
    found = found.select("query_id", ordinal.alias("position"), "chunk_id", "doc_ref", "chunk_index")
    first = slim.filter("rank = 1").join(found.select("query_id").distinct(), "query_id", "left_anti")
    return found.unionByName(first.select("query_id", F.lit(1).cast("long").alias("position"), "chunk_id", "doc_ref", F.col("chunk_index").cast("int").alias("chunk_index")))


def _by_query(*order: str):
    from pyspark.sql import Window

    return Window.partitionBy("query_id").orderBy(*order)


def answer_many(questions: DataFrame, chunks: DataFrame, docs: DataFrame, generator: Generator, k: int = 5, where: flt.Filters | None = None, model: str | None = None) -> DataFrame:
    """query_id, question, n_contexts, answer, citations (position, chunk_id, doc_ref, chunk_index) of questions (query_id, question, vector).

    Questions of one query_id are one question: ids are to be distinct. Without passages: a null
    answer, no citations.
    """
    hits = passages(questions, chunks, docs, k, where, model)
    place = f"{own_folder(chunks.sparkSession, 'answers')}/answers"
    generated(questions, hits, generator).write.parquet(place)  # a generator is asked once a question
    told = chunks.sparkSession.read.schema("query_id long, question string, n_contexts long, answer string").parquet(place)
    listed = cited(told, hits).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "chunk_id", "doc_ref", "chunk_index"))).alias("citations"))
    return told.join(listed, "query_id", "left").withColumn("citations", F.coalesce("citations", F.array().cast("array<struct<position:bigint,chunk_id:bigint,doc_ref:string,chunk_index:int>>")))
