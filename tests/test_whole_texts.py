"""Queries without SQL see whole documents, not their first characters."""

from ragspark.plans import reference_queries
from ragspark.plans.derived import Tables

FILLER = "Plain words stand here. " * 400


def test_words_after_the_preview(spark, tmp_path):
    rows = [(1, FILLER + "The license covers onions."), (2, FILLER)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    chunks = Tables(spark, str(tmp_path)).whole_chunks.collect()
    assert len({c.chunk_id for c in chunks}) == len(chunks) > 2
    assert max(len(c.text) for c in chunks) > 500
    found = reference_queries.queries()["stemmed_text_topk"](spark, str(tmp_path)).collect()
    assert {r.doc_id for r in found if r.text_score > 0} >= {1} and found[0].doc_id == 1
    mentions = reference_queries.queries()["extract_mentions"](spark, str(tmp_path)).collect()
    assert {r.doc_id for r in mentions if r.mention_text.lower() == "license"} == {1}
