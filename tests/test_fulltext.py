"""Stems, ranks and the rest of full text; tables."""

import pytest

from ragspark import schemas
from ragspark.functions import fulltext as ft
from ragspark.operators import evaluation, storage


@pytest.mark.parametrize(
    "word,expected",
    [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("sized", "size"), ("hopping", "hop"), ("falling", "fall"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("electrical", "electr"), ("revival", "reviv"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"), ("is", "is")],
)
def test_stem(word, expected):
    assert ft.stem(word) == expected


def test_rank():
    v = ft.lexemes("a fat cat sat")
    assert v == {"fat": [2], "cat": [3], "sat": [4]}
    assert ft.rank(v, ["cat"]) == pytest.approx(0.0607927, abs=1e-6)
    assert ft.rank(v, ["fat", "cat"]) == pytest.approx(0.0991032, abs=1e-6)
    assert ft.rank(v, ["dog"]) == 0 and not ft.matches(v, ["cat", "dog"]) and ft.matches(v, ["cat", "dog"], "or")
    assert not ft.matches(v, []) and ft.query_lexemes("What's (the) cats!") == ["cat"]


def test_columns(spark):
    d = spark.createDataFrame([(1, "Cats sat"), (2, None), (3, "dogs")], "id int, text string")
    got = {r.id: [(x.lexeme, x.positions) for x in r.text_tsv] for r in ft.with_vector(d).collect()}
    assert got == {1: [("cat", [1]), ("sat", [2])], 2: [], 3: [("dog", [1])]}
    assert [r.id for r in ft.scored(d, "cat").collect()] == [1]


def test_tables(spark):
    schemas.create(spark, "ragspark_test")
    assert spark.table("ragspark_test.chunks").columns[-1] == "embedding_model"
    m = spark.createDataFrame([("drug",), ("planet",)], "label string")
    assert schemas.valid_mentions(m).count() == 1
    spark.sql("DROP DATABASE ragspark_test CASCADE")


def test_summary_and_runs(spark):
    r = spark.createDataFrame([("a", "ok"), ("a", "error"), ("b", "skipped")], "topic string, status string")
    assert {tuple(x) for x in storage.ingest_summary(r).collect()} == {("a", 2, 1, 0, 1), ("b", 1, 0, 1, 0), ("all", 3, 1, 1, 1)}
    x = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "query_id int, chunk_id long, rank int")
    y = spark.createDataFrame([(0, 1, 1), (0, 3, 2)], "query_id int, chunk_id long, rank int")
    assert tuple(evaluation.compare_runs({"s1": x, "s2": y}, "s1").first()) == ("s2", 0, 0.333333, 0.5, 0.0)
