"""Stored tables and indexes are made in one pass, in order, over several files."""

from pyspark.sql import functions as F

from ragspark.operators import postings
from ragspark.plans import derived


def test_a_stored_table_is_made_once(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(derived, "FEW_ROWS", 100)
    made = spark.sparkContext.accumulator(0)
    source = spark.range(1000).select((F.col("id") * 7 % 1000).alias("doc_id"))

    def each(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    derived.in_order(source.mapInArrow(each, "doc_id long"), "doc_id", source, "doc_id", "doc_id").write.parquet(str(tmp_path / "t"))
    assert made.value == 1000  # a range shuffle made its rows twice
    files = [(r.a, r.b, r.n) for r in spark.read.parquet(str(tmp_path / "t")).groupBy(F.input_file_name()).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).collect()]
    files.sort()
    assert len(files) > 1 and sum(f[2] for f in files) == 1000 and all(x[1] < y[0] for x, y in zip(files, files[1:]))


def test_an_index_is_dealt_by_bounds(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(postings, "FEW_POSTINGS", 100)
    rows = [(i, f"the word{i % 5} x") for i in range(200)]
    index = postings.TextIndex.build(spark.createDataFrame(rows, "chunk_id long, text string"), str(tmp_path / "i"), "words", ())
    p = spark.read.parquet(f"{index.path}/postings")
    ends = sorted((r.a, r.b) for r in p.groupBy(F.input_file_name()).agg(F.min(F.struct("lexeme", "chunk_id")).alias("a"), F.max(F.struct("lexeme", "chunk_id")).alias("b")).collect())
    assert p.count() == 600 and len(ends) > 1 and all(x[1] < y[0] for x, y in zip(ends, ends[1:]))


def test_rows_that_a_join_drops_are_not_dealt(spark, monkeypatch):
    """Texts of all documents were shuffled to those that have a vector."""
    d = spark.range(20_000).select((F.col("id") - 5_000).alias("doc_id"))
    keys = spark.createDataFrame([(-4_999,), (-3,), (2_000,), (2_001,), (None,), (99_999_999,)], "doc_id long")
    some = derived.in_use(d, keys, "doc_id")
    assert some.count() <= 3 * derived.RANGE and some.join(keys, "doc_id").count() == 4
    monkeypatch.setattr(derived, "MOST_RANGES", 2)
    assert derived.in_use(d, keys, "doc_id").count() == 20_000


def test_what_is_known_of_documents_is_stored_without_texts(spark, sf_dir):
    t = derived.Tables(spark, sf_dir)
    assert t.docs.columns == [c for c in t.docs_with_text.columns if c != "text"] and t.docs.count() == t.docs_with_text.count()
