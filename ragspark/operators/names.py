"""An index of names for filters by a part of a name (C2, C4): trigrams of the distinct names, names to documents.

A filter's literal parts give trigrams; the names that have all of them are few and are checked as
the filter says; their documents are looked up. Everything is in order of what it is looked up by,
so a filter reads a few row groups, and only candidate documents are scanned and checked again: what
the index still holds of documents that have changed is harmless.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .filters import Filters

#: The letters of a gram.
GRAM = 3


def literal_runs(pattern: str) -> list[str]:
    """The parts of a LIKE pattern that stand for themselves, in lower case: cut at wildcards and escapes."""
    return [r for r in re.split(r"[%_\\]+", pattern.lower()) if r]


def grams_of(pattern: str) -> list[str]:
    return sorted({r[i : i + GRAM] for r in literal_runs(pattern) for i in range(len(r) - GRAM + 1)})


class NameIndex:
    """path/documents: kind, name, doc_id; path/grams: kind, gram, name; names in lower case, kinds author and institute."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, docs: DataFrame, path: str) -> NameIndex:
        """Of documents (doc_id, author: an array, institute). Null names and doc_ids are left out."""
        index = cls(docs.sparkSession, path)
        index._write(docs, "overwrite")
        return index

    def add(self, docs: DataFrame) -> None:
        """New and changed documents; the names that changed ones had stay until the index is built anew."""
        self._write(docs, "append")

    def _write(self, docs: DataFrame, mode: str) -> None:
        given = F.flatten(F.array(F.transform("author", lambda a: F.struct(F.lit("author").alias("kind"), F.lower(a).alias("name"))), F.array(F.struct(F.lit("institute").alias("kind"), F.lower("institute").alias("name")))))
        given = F.coalesce(given, F.array(F.struct(F.lit("institute").alias("kind"), F.lower("institute").alias("name"))))  # without authors
        rows = docs.select("doc_id", F.explode(given).alias("g")).select("g.kind", "g.name", "doc_id").filter("name is not null and doc_id is not null").distinct()
        rows.repartitionByRange("kind", "name", "doc_id").sortWithinPartitions("kind", "name", "doc_id").write.mode(mode).parquet(f"{self.path}/documents")
        names = rows.select("kind", "name").distinct().filter(F.length("name") >= GRAM)
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - GRAM + 1), lambda i: F.substring("name", i, F.lit(GRAM))))
        grams = names.select("kind", F.explode(grams).alias("gram"), "name")
        grams.repartitionByRange("kind", "gram", "name").sortWithinPartitions("kind", "gram", "name").write.mode(mode).parquet(f"{self.path}/grams")

    def documents(self, kind: str, patterns: list[str]) -> DataFrame:
        """doc_id of the documents with a name like any of the patterns; one row each."""
        places = self.spark.read.schema("kind string, name string, doc_id long").parquet(f"{self.path}/documents").filter(F.col("kind") == kind)
        found = None
        for p in patterns:
            grams = grams_of(p)
            if grams:
                listed = self.spark.read.schema("kind string, gram string, name string").parquet(f"{self.path}/grams").filter((F.col("kind") == kind) & F.col("gram").isin(grams))
                names = listed.distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams)).select("name")
            else:  # too short for grams: all names
                names = places.select("name").distinct()
            names = names.filter(F.col("name").like(f"%{p.lower()}%"))
            found = names if found is None else found.unionByName(names)
        return places.join(found.distinct(), "name", "left_semi").select("doc_id").distinct()

    def candidates(self, docs: DataFrame, f: Filters) -> DataFrame:
        """`docs` without those that the names of the filter rule out; the filter is still to be applied."""
        for kind, patterns in (("author", f.authors), ("institute", f.institutions)):
            if patterns:
                docs = docs.join(self.documents(kind, patterns), "doc_id", "left_semi")
        return docs
