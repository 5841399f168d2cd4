"""Operators on small tables: goldens and invariants."""

import math

import pytest
from pyspark.sql import functions as F

from ragspark.operators import chunking, evaluation, experiments, ner, retrieval, storage
from ragspark.operators.ivf import IvfIndex
from ragspark.plans.derived import MODEL, Tables


@pytest.fixture(scope="module")
def t(spark, sf_dir):
    return Tables(spark, sf_dir)


def ids(df):
    return [r.chunk_id for r in df.collect()]


@pytest.mark.parametrize("n,expected", [(0, 0), (1, 0.289065), (3, 0.578130), (9, 0.960253), (10, 1), (20, 1)])
def test_ner_score(spark, n, expected):
    assert spark.range(1).select(retrieval.ner_score(F.lit(n)).alias("x")).first().x == pytest.approx(expected, abs=1e-6)


def test_no_boost_is_vector_only(t):
    q = t.vector()
    assert ids(retrieval.ner_boost(t.chunks, t.mentions, q, 10, MODEL, weight=0.0)) == ids(retrieval.vector_only(t.chunks, q, 10, MODEL))


def test_rrf_bound(t):
    top = retrieval.hybrid_rrf(t.chunks, t.vector(), "the of", 10, MODEL).agg(F.max("final_score").alias("m")).first().m
    assert top <= 2 / 61 + 1e-8


def test_no_text_match_never_fails(t):
    rows = retrieval.full_hybrid(t.chunks, t.mentions, t.vector(), "zzzzqqq", 5, MODEL).collect()
    assert len(rows) == 5 and all(r.final_score is not None for r in rows)


def test_filters_only_take_away(t):
    from ragspark.operators.filters import Filters

    wide = set(ids(retrieval.filtered(t.chunks, t.docs, t.vector(), Filters(), 1000)))
    narrow = set(ids(retrieval.filtered(t.chunks, t.docs, t.vector(), Filters(sources=["arXiv"], year_min=2010), 1000)))
    assert narrow < wide


def test_ivf_all_probes_is_exact(spark, t, tmp_path):
    index = IvfIndex.build(t.chunks, str(tmp_path / "ivf"), 8, MODEL)
    assert ids(index.search(t.vector(), 10, 8)) == ids(retrieval.vector_only(t.chunks, t.vector(), 10, MODEL))
    assert len(ids(index.search(t.vector(), 3, 1))) <= 3
    again = IvfIndex.open(spark, str(tmp_path / "ivf"))
    assert ids(again.search(t.vector(), 10, 3)) == ids(index.search(t.vector(), 10, 3))
    assert again.verify().agg(F.sum("rows")).first()[0] == retrieval.of_model(t.chunks, MODEL).count()
    again.drop()
    assert not (tmp_path / "ivf").exists()


def test_ivf_settings():
    from ragspark.operators import ivf

    assert ivf.default_probes(96) == 6 and ivf.default_probes(3) == 1 and ivf.suggested_lists(10_000) == 150
    assert ivf.check_lists(150, 10_000)
    with pytest.warns(UserWarning):
        assert not ivf.check_lists(20, 10_000)


def test_forced_assignment(spark):
    e = experiments.Experiment()
    e.register("a")
    r = e.assign(spark.createDataFrame([("u", "s")], "user_id string, session_id string"), forced="a").first()
    assert (r.strategy, r.experiment_id) == ("a", "forced_a")


def test_stems_find_more(t):
    assert retrieval.text_matches(t.chunks, "the eren", 5, "or", rank="stems").count() >= 0


def test_upserts(spark):
    old = spark.createDataFrame([(0, "a", "T", None), (1, "b", "U", 1)], "doc_id long, ext_id string, title string, year int")
    new = spark.createDataFrame([("a", None, 2020), ("c", "V", 3)], "ext_id string, title string, year int")
    once = storage.upsert_documents(old, new)
    rows = {r.ext_id: (r.doc_id, r.title, r.year) for r in once.collect()}
    assert rows == {"a": (0, "T", 2020), "b": (1, "U", 1), "c": (2, "V", 3)}
    assert {tuple(r) for r in storage.upsert_documents(once, new).collect()} == {tuple(r) for r in once.collect()}
    c = spark.createDataFrame([(1, i, "old") for i in range(3)], "doc_id long, chunk_index int, text string")
    n = spark.createDataFrame([(1, i, "new") for i in range(2)], "doc_id long, chunk_index int, text string")
    assert {(r.chunk_index, r.text) for r in storage.upsert_chunks(c, n).collect()} == {(0, "new"), (1, "new"), (2, "old")}


def test_numbers_are_dense(spark):
    rows = storage.number_from(spark.range(1000).select(F.col("id").cast("string").alias("k")), "k", 7).collect()
    assert sorted(r._id for r in rows) == list(range(7, 1007))


def test_plan(spark):
    docs = spark.createDataFrame([(1, "d1"), (2, "d2")], "doc_id long, source_id string")
    chunks = spark.createDataFrame([(2, "m")], "doc_id long, embedding_model string")
    want = spark.createDataFrame([("d0",), ("d1",), ("d2",)], "source_id string")
    assert {r.source_id: r.todo for r in storage.plan(want, docs, chunks, "m").collect()} == {"d0": True, "d1": True, "d2": False}
    assert all(r.todo for r in storage.plan(want, docs, chunks, "m", force=True).collect())


def test_mentions_are_added_once(spark):
    m = spark.createDataFrame([(1, 0, 2, "CT", "device")], "doc_id long, start_char int, end_char int, mention_text string, label string")
    assert storage.append_mentions(m, m.union(m)).count() == 1


def test_chunk_sections():
    s = [("A", "a1 a2."), ("B", "b1 b2 b3.")]
    assert chunking.chunk_sections(s, 4, 2, compat=True) == [("[B]\na1 a2.", "B"), ("[B]\nb1 b2 b3.", "B")]
    assert chunking.chunk_sections(s, 4, 2) == [("[A]\na1 a2.", "A"), ("[B]\nb1 b2 b3.", "B")]


def test_sections():
    assert chunking.sections_of("plain text") == [("Section 1", "plain text")]
    got = chunking.sections_of("1. Introduction\nHello there.\nMETHODS\nWe did.\n")
    assert [n for n, _ in got] == ["1. Introduction", "METHODS"]
    assert chunking.sections_of("") == [("Section 1", "")]


def test_chunks_cover_all_sentences(t):
    text = "One two three. Four five six seven. Eight nine. Ten eleven twelve thirteen."
    chunks = chunking.chunk_text(text, 6, 2)
    for s in chunking.split_sentences(text):
        assert any(s in c for c, _ in chunks)
    assert t.docs.count() == chunking.chunk_documents(t.raw("documents"), 200, 20).select("doc_id").distinct().count()


def test_blocks():
    got = chunking.chunk_blocks([("title", "The Title"), ("heading", "Methods"), ("para", "We did it. Then more.")], 50, 5)
    assert len(got) == 1 and got[0][1] == "Section 1" and "We did it." in got[0][0]


def test_entities():
    (e,) = [x for x in ner.entities("arXiv:1\n\n[Methods]\nA CT scan") if x[1] == "device"]
    assert (e[0], e[2], e[3]) == ("CT", 21, 23) and e[5] == 0.85
    stats = [(x[0], x[2]) for x in ner.entities("(p < 0.05)")]
    assert stats == [("p < 0.05", 1)]
    assert [x[0] for x in ner.entities("CI: 1.2-3.4")] == ["CI: 1.2-3.4"]
    assert [x[0] for x in ner.entities("95% CI [1.2, 3.4]")] == ["95% CI"]
    assert ner.entities(None) == []


def test_dedup_mentions(spark):
    rows = [("CT ", "device", "Intro", 0, 0), ("ct", "device", "Intro", 0, 1), ("ct", "device", None, 0, 2)]
    m = spark.createDataFrame([(1, *r) for r in rows], "doc_id long, mention_text string, label string, section_name string, chunk_index int, ordinal int")
    assert {r.ordinal for r in ner.dedup(m).collect()} == {0, 2}


def test_ab_statistics(spark):
    log = spark.createDataFrame([("user_interaction", "s", 10.0, [1, 2], 5), ("user_interaction", "s", 20.0, [], 0), ("strategy_assignment", "s", 9.0, [], 1)], "event string, strategy string, latency_ms double, clicked_chunk_ids array<long>, user_rating int")
    assert tuple(experiments.statistics(log).first()) == ("s", 2, 15.0, 1.0, 5.0)


def test_feedback_is_kept(spark):
    log = experiments.interactions(spark.createDataFrame([("e1", "s", 1.0)], "experiment_id string, strategy string, latency_ms double"))
    back = spark.createDataFrame([("e1", [7], 4)], "experiment_id string, clicked_chunk_ids array<long>, user_rating int")
    r = experiments.with_feedback(log, back).first()
    assert (r.clicked_chunk_ids, r.user_rating, r.event) == ([7], 4, "user_interaction")


def test_weighted_assignment(spark):
    e = experiments.Experiment()
    e.register("a", weight=3)
    e.register("b", weight=1)
    n = {r.strategy: r["count"] for r in spark.range(4000).select(e.weighted(1).alias("strategy")).groupBy("strategy").count().collect()}
    assert 0.7 < n["a"] / 4000 < 0.8


def lists(spark, items):
    return spark.createDataFrame([(0, c, i + 1) for i, c in enumerate(items)], "query_id int, chunk_id long, rank int")


@pytest.mark.parametrize("a,b,expected", [([1, 2, 3], [3, 2, 1], -1.0), ([1, 2, 3, 4], [9, 8, 1, 2], -7.0), ([1], [1], 0.0)])
def test_rank_correlation(spark, a, b, expected):
    assert evaluation.rank_correlation(lists(spark, a), lists(spark, b)).first().rank_correlation == expected


def test_precision_recall(spark):
    r = evaluation.precision_recall(lists(spark, [1, 2, 3, 4]), lists(spark, [3, 4, 5])).first()
    assert (r.precision, r.recall, r.f1) == (0.5, 0.666667, 0.571429)


def test_percentiles(spark):
    d = spark.createDataFrame([("s", 1.0), ("s", 2.0), ("s", 10.0), ("s", None)], "g string, v double")
    r = evaluation.latency_by_index(d, "g", "v").first()
    assert (r.p95, r.median, r.mean) == (10.0, 2.0, 3.25)
    assert evaluation.latency_linear(d, "g", "v").first().p95 == pytest.approx(9.2)


def test_bands():
    assert evaluation.level_band(0.31) == "high" and evaluation.level_band(0.2) == "moderate" and evaluation.level_band(0.1) == "low"
    assert evaluation.robustness_band(0.836, 0.744) == "robust"


def test_pca_sums_to_one(t):
    e = evaluation.pca_energy(t.raw("embeddings"))
    assert math.isclose(sum(e["explained"]), 1, abs_tol=1e-9) and e["components"][0.8] <= e["components"][0.95]


def test_plan_shapes(t):
    """Filters and columns reach the scan; the top k is a partial one a task."""
    plan = t.chunks.sparkSession._jvm.PythonSQLUtils.explainString(retrieval.vector_only(t.chunks, t.vector(), 10, MODEL)._jdf.queryExecution(), "formatted")
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan
    one = t.raw("orders").filter("o_custkey = 5").select("o_orderkey")
    text = one.sparkSession._jvm.PythonSQLUtils.explainString(one._jdf.queryExecution(), "formatted")
    assert "EqualTo(o_custkey,5)" in text and "o_totalprice" not in text
