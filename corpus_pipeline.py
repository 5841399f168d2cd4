"""A corpus from raw documents to packed sequences; each stage reads what the one before wrote.

language: documents whose text is null or has no letter go, and a null lang is predicted. near_duplicates: one document of each
group of linked ones stays. secrets: found spans are masked in the text, n_chars is counted anew.
mixing: each source's documents are taken so often (not at all, once, twice) that its words come
near its target; a document taken twice is two rows. packing: the pieces of all that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.llm import jaccard, langid, mixing, packing, secrets
from ragspark.llm.common import Scratch, shrink_heaps

#: The columns of documents, which all stages but the last return.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts and texts without a letter go; all else stays, repeated rows too, whatever is null beside the text.

    A null lang becomes the language predicted from the text.
    Columns other than COLUMNS go, here and in the next three stages; an empty table stays empty in all.
    """
    return langid.keep_identified(docs.select(COLUMNS), langid.fit(spark, docs), spark)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents that of the smallest doc_id stays (null last); texts without words all stay.

    Of repeated rows one stays; different texts under one doc_id are different documents.
    """
    shrink_heaps(spark)
    return jaccard.keep_one(spark, docs.select(COLUMNS), Scratch(spark, "pipeline-near"))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; null and empty texts as they are; a null n_chars is set only where the text changed."""
    shrink_heaps(spark)
    return secrets.redact_documents(docs.select(COLUMNS))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null sources are a source; a text without words counts 0 and is taken as its source's others are.

    A source without any word has target 0 and goes; repeated rows are taken each for itself.
    """
    shrink_heaps(spark)
    mixed = mixing.mix_sources(docs.select(COLUMNS).withColumn("size", mixing.word_count("text")), Scratch(spark, "pipeline-mix").save)
    return mixed.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(COLUMNS)


def lexical_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts are an end id alone; repeated rows are packed each for itself; a long text goes on in the next sequence."""
    shrink_heaps(spark)
    return packing.pack_documents(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secret_masking), ("mixing", source_mixing), ("packing", lexical_packing)]

#: SQL has neither the kernel, the shingles' classes nor the tokenizer; tests hold run() against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        with Scratch.scope():  # the stage's own tables go when its rows are written
            docs = scratch.save(stage(spark, docs, sf_dir), f"{i}-{name}")
        if i:
            scratch.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs
