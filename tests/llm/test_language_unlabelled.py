"""A table without any usable language keeps every text with a letter."""

from ragspark.llm import langid


def test_nothing_learned(spark, docs):
    d = docs([(1, "some words", None, "s"), (2, None, None, "s"), (3, "12 34", None, "s"), (4, "", None, "s"), (5, "é", None, "s")])
    model = langid.fit(spark, d)
    assert model.langs == []
    assert sorted(r.doc_id for r in langid.keep_identified(d, model, spark).collect()) == [1, 5]
