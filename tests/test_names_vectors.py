"""Filters by parts of names through trigrams, and the vectors of mentions as ingest keeps them."""

import random

import numpy as np
import pytest

from ragspark.operators import filters as flt
from ragspark.operators import mention_vectors as mv
from ragspark.operators import retrieval
from ragspark.operators.names import NameIndex, grams_of
from ragspark.plug import HashEmbedder

DOCS = "doc_id long, author array<string>, institute string, source string, year date"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    name = lambda: "".join(rng.choice("abAé %_") for _ in range(rng.randint(0, 7)))
    rows = [(i, None if i % 11 == 0 else [None if rng.random() < 0.1 else name() for _ in range(rng.randint(0, 3))], None if i % 7 == 0 else name(), "s", None) for i in range(300)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def index(docs, tmp_path_factory):
    return NameIndex.build(docs, str(tmp_path_factory.mktemp("names")))


@pytest.mark.parametrize("authors, places", [(["ab"], None), (["aba", "É"], None), (None, ["a%b"]), (["b_a"], ["aa"]), ([""], None), (["zzz"], None), (["bab", "zzz"], ["b", "aab"]), (["Ba "], ["%"])])
def test_same_documents_as_a_scan(docs, index, authors, places):
    f = flt.Filters(authors=authors, institutions=places)
    want = sorted(r.doc_id for r in docs.filter(flt.build(f)).collect())
    assert sorted(r.doc_id for r in index.candidates(docs, f).filter(flt.build(f)).collect()) == want


def test_grams_and_what_is_read(index):
    assert grams_of("%Ab_cdeF%g") == ["cde", "def"] and grams_of("ab") == []
    plan = index.documents("author", ["abab"])._jdf.queryExecution().toString()
    assert "In(gram, [aba,bab])" in plan and "EqualTo(kind,author)" in plan


def test_added_and_changed_documents(spark, docs, tmp_path):
    index = NameIndex.build(docs, str(tmp_path / "n"))
    new = spark.createDataFrame([(0, ["Nova Name"], "x", "s", None), (999, ["Nova Other"], None, "s", None)], DOCS)
    index.add(new)
    now = docs.filter("doc_id <> 0").unionByName(new)
    f = flt.Filters(authors=["nova"])
    assert sorted(r.doc_id for r in index.candidates(now, f).filter(flt.build(f)).collect()) == [0, 999]


def test_filtered_search_through_the_index(spark, docs, index):
    chunks = docs.selectExpr("doc_id as chunk_id", "doc_id", "array(1D, doc_id / 10D) as embedding")
    f = flt.Filters(authors=["ab"], institutions=["a"])
    both = [sorted(map(tuple, retrieval.filtered(chunks, docs, [1.0, 3.0], f, 7, None, n).collect())) for n in (None, index)]
    assert both[0] == both[1] and len(both[0]) == 7


def test_mention_vectors(spark):
    m = [(1, "CT "), (2, "ct"), (3, "Drug"), (None, "x"), (4, None), (5, " "), (3, "Drug")]
    df = spark.createDataFrame(m, "mention_id long, mention_text string")
    got = {r.mention_id: r.embedding for r in mv.mention_vectors(df, HashEmbedder(16)).collect()}
    assert set(got) == {1, 2, 3} and got[1] == got[2]
    assert got[3] == pytest.approx(np.round(HashEmbedder(16).encode(["drug"])[0], 6).tolist(), abs=1e-6)
    known = mv.mention_vectors(df.filter("mention_id = 3"), HashEmbedder(16)).union(spark.createDataFrame([(77, [1.0] * 16)], "mention_id long, embedding array<float>").selectExpr("*", "current_timestamp()"))
    after = {r.mention_id for r in mv.kept_up(known, df, HashEmbedder(16)).collect()}
    assert after == {1, 2, 3}


def test_ingest_fills_the_vectors(spark):
    from ragspark.engine import Engine

    docs = spark.createDataFrame([], "doc_id long, ext_id string, title string, source string, source_id string, author array<string>, institute string, year date, text string")
    chunks = spark.createDataFrame([], "chunk_id long, doc_id long, chunk_index int, text string, embedding array<float>, embedding_model string, section_name string")
    mentions = spark.createDataFrame([], "mention_id long, doc_id long, mention_text string, label string, start_char int, end_char int, section_name string")
    new = spark.createDataFrame([("pmcid://pmc1", "t", "PubMed Central", "1", "A CT scan and an MRI. The stent was used."), ("pmcid://pmc2", "u", "PubMed Central", "2", "Another CT scan, p < 0.05.")], "ext_id string, title string, source string, source_id string, text string")
    engine = Engine(spark, docs, chunks, mentions, HashEmbedder(64)).ingest(new)
    ids = {r.mention_id for r in engine.mentions.collect()}
    assert ids and {r.mention_id for r in engine.mention_vectors.collect()} == ids
    assert engine.similar_mentions("ct", k=1).first().mention_text.lower() == "ct"
    told = engine.answer_many(spark.createDataFrame([(1, "Which scan was used?"), (2, "And the stent?")], "query_id long, question string"), 2).collect()
    assert len(told) == 2 and all(r.citations for r in told)
