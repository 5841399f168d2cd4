"""What the filters can be set to (E6-E10, A.6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sources(docs: DataFrame) -> DataFrame:
    return docs.filter("source is not null").select("source").distinct().orderBy("source")


def year_range(docs: DataFrame) -> DataFrame:
    return docs.agg(F.min(F.year("year")).cast("long").alias("min_year"), F.max(F.year("year")).cast("long").alias("max_year"))


def document_count(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("document_count"))


def top_authors(docs: DataFrame, n: int = 20) -> DataFrame:
    """A name listed twice in a document counts twice; ties by name."""
    names = docs.select(F.explode("author").alias("name"))
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("document_count")).orderBy(F.desc("document_count"), "name").limit(n)


def top_institutions(docs: DataFrame, n: int = 20) -> DataFrame:
    d = docs.filter("institute is not null and institute <> ''")
    return d.groupBy(F.col("institute").alias("name")).agg(F.count(F.lit(1)).alias("document_count")).orderBy(F.desc("document_count"), "name").limit(n)


def facets(docs: DataFrame) -> dict:
    """All of them as one dict (bounded: the lists have 20 names, sources are few)."""
    years = year_range(docs).first()
    return {
        "sources": [r.source for r in sources(docs).collect()],
        "year_range": {"min": years.min_year or None, "max": years.max_year or None},
        "document_count": document_count(docs).first().document_count,
        "top_authors": [r.asDict() for r in top_authors(docs).collect()],
        "top_institutions": [r.asDict() for r in top_institutions(docs).collect()],
        "usage_examples": {"authors": ["Smith"], "year_min": 2020, "year_max": 2024, "sources": ["PubMed Central"]},
    }
