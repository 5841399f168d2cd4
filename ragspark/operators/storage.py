"""Upserts, purges and planners as set operations.

Parquet has no MERGE: an upsert is a join of the old and the new rows, written as a new version.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def last_values(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row a key: of each column the last value that is not null, rows being in order of their text form."""
    r = rows.withColumn("_text", F.to_json(F.struct(*rows.columns)))
    last = [F.expr(f"max_by(`{c}`, CASE WHEN `{c}` IS NOT NULL THEN _text END)").alias(c) for c in rows.columns if c not in key]
    return r.groupBy(*key).agg(*last, F.max("_text").alias("_text")).drop("_text").select(rows.columns)


def merge_rows(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """`old` with the values of `new` (columns that it lacks stay) where they are not null, and with its new keys; nulls in keys are equal.

    Repeated new rows are merged column by column first. Columns of `old`, in its order.
    """
    n = last_values(new.select([c for c in new.columns if c in old.columns]), key)
    mark = lambda df: df.withColumn("_key", F.struct(*key))
    j = mark(old).alias("o").join(mark(n).alias("n"), F.col("o._key").eqNullSafe(F.col("n._key")), "full_outer")
    value = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in n.columns else F.col(f"o.{c}")
    return j.select(*map(value, old.columns))


def upsert_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """B1: keyed by ext_id; a null never erases; new documents get ids above the largest.

    New rows with one ext_id are merged column by column: of each column the last value that is not
    null, in order of the rows' text form. A null ext_id matches nothing: old rows without one stay,
    and each new row without one is a new document. New ids come from counts by partition of a sort,
    not from one global window.
    """
    cols = [c for c in old.columns if c not in ("ext_id", "doc_id")]
    named = last_values(new.filter("ext_id is not null"), ["ext_id"]).withColumn("_key", F.concat(F.lit("e"), "ext_id"))
    unnamed = new.filter("ext_id is null").withColumn("_text", F.to_json(F.struct(*new.columns)))
    unnamed = unnamed.withColumn("_r", F.row_number().over(Window.partitionBy("_text").orderBy("_text")))
    unnamed = unnamed.withColumn("_key", F.concat(F.lit("n"), "_text", F.lit("#"), F.col("_r").cast("string"))).drop("_text", "_r")
    n = named.unionByName(unnamed)
    j = old.withColumn("_key", F.concat(F.lit("e"), "ext_id")).alias("o").join(n.alias("n"), "_key", "full_outer")
    kept = j.select("_key", F.coalesce("o.ext_id", "n.ext_id").alias("ext_id"), "o.doc_id", *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) if c in n.columns else F.col(f"o.{c}") for c in cols])
    fresh = number_from(kept.filter("doc_id is null").select("_key"), "_key", old.agg(F.coalesce(F.max("doc_id"), F.lit(-1)).alias("top")).first().top + 1)
    out = kept.join(fresh, "_key", "left").withColumn("doc_id", F.coalesce("doc_id", "_id")).drop("_id")
    return out.select(*old.columns)


def number_from(rows: DataFrame, key: str, start: int) -> DataFrame:
    """key, _id: 0, 1, ... in order of the key (distinct), without one task for all rows.

    Rows are cut into 256 ranges by hash order; only the ranges' counts meet in one place.
    """
    part = F.shiftright(F.xxhash64(key), 56).cast("int")
    k = rows.select(key).withColumn("_p", part)
    counts = k.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).alias("_before"))
    inner = k.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(key)))
    return inner.join(F.broadcast(before), "_p").select(key, (F.lit(start) + F.col("_before") + F.col("_i") - 1).cast("long").alias("_id"))


def upsert_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """B2: keyed by (doc_id, chunk_index); the new row holds, old higher indices stay."""
    return old.join(new.select("doc_id", "chunk_index"), ["doc_id", "chunk_index"], "left_anti").unionByName(new, allowMissingColumns=True)


def purge_chunks(chunks: DataFrame, doc_ids: DataFrame, model: str) -> DataFrame:
    """Without the chunks of these documents and this model."""
    gone = doc_ids.select("doc_id").distinct().withColumn("embedding_model", F.lit(model))
    return chunks.join(gone, ["doc_id", "embedding_model"], "left_anti")


def append_mentions(old: DataFrame, new: DataFrame) -> DataFrame:
    """B4, made idempotent: a mention that is there (same document, span, text, label; nulls are equal) is not added again."""
    key = ["doc_id", "start_char", "end_char", "mention_text", "label"]
    there = old.select(*(F.col(c).alias(f"_{c}") for c in key))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key))
    return old.unionByName(new.join(there, same, "left_anti").dropDuplicates(key), allowMissingColumns=True)


def insert_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """Identifiers whose (id_type, lower(id_value)) is not there yet; of equal new ones the smallest doc_id."""
    key = F.lower("id_value")
    first = new.withColumn("_k", key).withColumn("_r", F.row_number().over(Window.partitionBy("id_type", "_k").orderBy("doc_id", "id_value"))).filter("_r = 1").drop("_r")
    there = old.select("id_type", key.alias("_k")).distinct()
    return old.unionByName(first.join(there, ["id_type", "_k"], "left_anti").drop("_k"))


def swap(df: DataFrame, path: str) -> str:
    """Writes a new version beside the old ones and returns its folder; readers of the old keep it."""
    version = f"{path}/v-{uuid.uuid4().hex}"
    df.write.parquet(version)
    return version


# The kinds under which a journal's and an archive's DOI are kept.
DOI_KINDS = ("doi", "arxiv-doi")


def docs_without_doi(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Without a DOI of any kind."""
    return docs.join(ids.filter(F.col("id_type").isin(*DOI_KINDS)).select("doc_id"), "doc_id", "left_anti")


def docs_without_mentions(chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    """Documents with chunks and no mention."""
    return chunks.select("doc_id").distinct().join(mentions.select("doc_id"), "doc_id", "left_anti")


def chunks_of_docs_with_mentions(chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    """D11."""
    return chunks.join(mentions.select("doc_id"), "doc_id", "left_semi")


def plan(ids: DataFrame, docs: DataFrame, chunks: DataFrame, model: str, force: bool = False) -> DataFrame:
    """source_id with todo: the document is missing, has no chunk of the model, or force."""
    if force:
        return ids.select("source_id", F.lit(True).alias("todo"))
    done = docs.join(chunks.filter(F.col("embedding_model") == model).select("doc_id"), "doc_id", "left_semi").select("source_id").distinct()
    return ids.join(done.withColumn("_d", F.lit(True)), "source_id", "left").select("source_id", F.col("_d").isNull().alias("todo"))


def newest(docs: DataFrame, n: int = 1000, after: int | None = None, since=None) -> DataFrame:
    """G14."""
    d = docs if after is None else docs.filter(F.col("doc_id") > after)
    d = d if since is None else d.filter(F.col("captured_at") >= F.lit(since))
    return d.select("doc_id").orderBy(F.desc("doc_id")).limit(n)


def high_water_mark(docs: DataFrame) -> DataFrame:
    """E11."""
    return docs.agg(F.coalesce(F.max("doc_id"), F.lit(0)).cast("long").alias("max_doc_id"))


def new_since(docs: DataFrame, mark: int) -> DataFrame:
    """K1: the first run (mark 0) takes the newest 1000."""
    return newest(docs) if not mark else docs.filter(F.col("doc_id") > mark).select("doc_id")


def chunk_counts_by_model(chunks: DataFrame) -> DataFrame:
    """E4."""
    return chunks.groupBy("doc_id", "embedding_model").agg(F.count(F.lit(1)).alias("chunks"))


def chunks_per_doc(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """E20."""
    return docs.select("doc_id").join(chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks")), "doc_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0).cast("long")))


def coverage(chunks: DataFrame) -> DataFrame:
    """B14."""
    return chunks.agg(F.count(F.lit(1)).alias("total"), F.count("text").alias("with_text"))


def doi_counts(ids: DataFrame) -> DataFrame:
    """Documents with a journal DOI, with an archive's, with any; of either kind, in one pass."""
    doi = F.col("id_type").isin(*DOI_KINDS)
    arxiv = (F.col("id_type") == "arxiv-doi") | F.lower("id_value").startswith("10.48550/")
    return ids.agg(F.count_distinct(F.when(doi & ~arxiv, F.col("doc_id"))).alias("journal"), F.count_distinct(F.when(doi & arxiv, F.col("doc_id"))).alias("arxiv"), F.count_distinct(F.when(doi, F.col("doc_id"))).alias("total"))


def found_dois(docs: DataFrame) -> DataFrame:
    """doc_id, id_type, id_value: an arXiv document's archive DOI, and the journal's DOI that any document's fields hold."""
    from ..functions.identifiers import arxiv_doi, find_doi

    archive = F.when(F.col("source") == "arXiv", F.struct(F.lit("arxiv-doi").alias("id_type"), arxiv_doi(F.col("source_id")).alias("id_value")))
    journal = F.struct(F.lit("doi").alias("id_type"), find_doi(F.coalesce("doi", "source_uri")).alias("id_value"))
    return docs.select("doc_id", F.explode(F.array(archive, journal)).alias("_k")).select("doc_id", "_k.*").filter("id_value is not null")


def enrich(spark: SparkSession, docs: DataFrame, ids: DataFrame, mark: int) -> tuple[DataFrame, dict]:
    """K1, I31, A.7: documents above the mark get the DOIs found for them that are not there yet; and the totals."""
    todo = docs.join(new_since(docs, mark), "doc_id", "left_semi")
    after = insert_ids(ids, found_dois(todo))
    counts = doi_counts(after).first()
    return after, {"processed": todo.count(), "journal_dois": counts.journal, "arxiv_dois": counts.arxiv, "total_dois": counts.total}


def ingest_summary(results: DataFrame) -> DataFrame:
    """Found, ingested, skipped, errors by topic and of all; results: topic, status."""
    counts = [F.count(F.lit(1)).alias("found")] + [F.count(F.when(F.col("status") == s, 1)).alias(n) for s, n in (("ok", "ingested"), ("skipped", "skipped"), ("error", "errors"))]
    return results.rollup("topic").agg(*counts).withColumn("topic", F.coalesce("topic", F.lit("all")))


def capped(chunks: DataFrame, most: int) -> DataFrame:
    """Each document's first chunks."""
    return chunks.filter(F.col("chunk_index") < most)


def chunk_metadata(tokens: int, overlap: int, model: str, source: str | None = None) -> Column:
    """The JSON kept with a chunk; with a source its id goes under source_id, else under pmcid."""
    key = [F.lit(source).alias("source"), F.col("source_id")] if source else [F.col("source_id").alias("pmcid")]
    return F.to_json(F.struct(*key, "chunk_index", F.lit(tokens).alias("chunk_tokens"), F.lit(overlap).alias("chunk_overlap"), F.lit(model).alias("embedding_model"), "section_name"))
