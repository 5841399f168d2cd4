"""The operators applied to their whole tables, with production parameters, and DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import align, ann, jaccard, langid, lm, mixing, neardup, packing, secrets, toxicity, trie, voronoi, warc
from .common import Scratch, table


def op1_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark, table(spark, sf_dir, "embeddings"), Scratch(spark, "op1"))


def op2_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op2")
    return warc.deduplicate(spark, table(spark, sf_dir, "pages"), scratch.path("archives"), scratch.save)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(spark, table(spark, sf_dir, "documents"), Scratch(spark, "op3"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(spark, docs, langid.fit(spark, docs))


def op5_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"), Scratch(spark, "op5"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "op6")
    sized = scratch.save(docs.select("doc_id", "source", mixing.word_count("text").alias("size")), "sized")
    return mixing.mix_sources(sized, scratch.save).select("doc_id", "size", "source_size", "target", "copies", "taken")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(spark, docs, toxicity.fit(spark, docs, table(spark, sf_dir, "labels"), Scratch(spark, "op7")))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), Scratch(spark, "op9"))


def op10_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.search(spark, table(spark, sf_dir, "embeddings"), Scratch(spark, "op11"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"), Scratch(spark, "op12"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(spark, table(spark, sf_dir, "documents"), Scratch(spark, "op13"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_rp_forest, op2_warc_revisit, op3_jaccard_join, op4_language_id, op5_embedding_neardup, op6_source_mixing, op7_toxicity, op8_secret_scan, op9_lm_scoring, op10_lexical_packing, op11_voronoi_topk, op12_prefix_trie, op13_token_alignment)}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_revisit": warc.WARC_SQL, "op3_jaccard_join": jaccard.JACCARD_SQL, "op5_embedding_neardup": neardup.NEAR_SQL, "op6_source_mixing": mixing.MIX_SQL, "op11_voronoi_topk": voronoi.VORONOI_SQL, "op12_prefix_trie": trie.TRIE_SQL}
