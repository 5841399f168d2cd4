"""A/B answers, fallbacks and pages, stemmed hybrid search, nulls in upserts, percentiles, compatible chunks."""

import json

import pytest
from pyspark.sql import functions as F

from ragspark.engine import Engine
from ragspark.functions import fulltext
from ragspark.operators import chunking, evaluation, experiments, ner, retrieval, storage
from ragspark.operators.ivf import IvfIndex, suggested_lists
from ragspark.plans.derived import MODEL, Tables
from ragspark.plug import HashEmbedder
from ragspark.schemas import AB_EVENTS
from ragspark.sources import files, parsing, requests


@pytest.fixture(scope="module")
def t(spark, sf_dir):
    return Tables(spark, sf_dir)


class Words64(HashEmbedder):
    def __init__(self):
        super().__init__(64)


def an_experiment():
    e = experiments.Experiment()
    for name in retrieval.STRATEGIES:
        e.register(name)
    return e


def test_ab_answer_logs_one_event(spark, t, tmp_path):
    engine = Engine(spark, t.docs, t.chunks, t.mentions, Words64())
    forced = engine.ab_answer("the of and", an_experiment(), "u1", "s1", forced="ivfflat_tsvector", log_path=str(tmp_path / "log"))
    assert forced["experiment_id"] == "forced_ivfflat_tsvector" and len(forced["citations"]) == 3 and len(forced["contexts"]) == 5
    again = [engine.ab_answer("the of and", an_experiment(), "u1", log_path=str(tmp_path / "log")) for _ in range(2)]
    assert again[0]["strategy"] == again[1]["strategy"] and again[0]["experiment_id"] != again[1]["experiment_id"]
    log = spark.read.schema(AB_EVENTS).json(str(tmp_path / "log"))
    rows = log.collect()
    assert len(rows) == 3 and {r.event for r in rows} == {"user_interaction"} and all(r.results_count == 5 and r.latency_ms > 0 for r in rows)
    with pytest.raises(ValueError):
        engine.ab_answer("x", an_experiment(), forced="none of these")
    stats = experiments.export(log, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out" / "stats"))
    assert {r.strategy: r.queries for r in back.collect()} == {r.strategy: r.queries for r in stats.collect()}
    assert spark.read.schema(AB_EVENTS).json(str(tmp_path / "out" / "interactions")).count() == 3


def test_extractor_is_used(spark):
    class Capitals:
        """An extractor of words in capitals; here, so that workers need not import this module."""

        def extract(self, text):
            import re

            return [(m[0], "DISEASE", m.start(), m.end()) for m in re.finditer(r"\b[A-Z]{4,}\b", text)]

    c = spark.createDataFrame([(1, "S", 0, "p12\n\n[S]\nSome ASTHMA here.")], "doc_id long, section_name string, chunk_index int, text string")
    found = ner.extract_mentions(c, extractor=Capitals()).collect()
    assert [(r.mention_text, r.label, r.context) for r in found] == [("ASTHMA", "disease", "Some ASTHMA here.")]
    assert "p12\n\n[S]\nSome ASTHMA here."[found[0].start_char : found[0].end_char] == "ASTHMA"


def test_null_ext_ids_are_new_documents(spark):
    schema = "doc_id long, ext_id string, title string"
    old = spark.createDataFrame([(0, "a", "A"), (1, None, "N")], schema)
    new = spark.createDataFrame([("a", None), ("b", "B"), (None, "n1"), (None, "n2"), (None, "n2")], "ext_id string, title string")
    got = sorted((tuple(r) for r in storage.upsert_documents(old, new).collect()), key=repr)
    assert len(got) == 6 and len({r[0] for r in got}) == 6 and all(r[0] is not None for r in got)
    assert sorted((r[1] or "-", r[2]) for r in got) == [("-", "N"), ("-", "n1"), ("-", "n2"), ("-", "n2"), ("a", "A"), ("b", "B")]


def test_enrich_writes_both_dois(spark):
    docs = spark.createDataFrame([(1, "arXiv", "2401.1", "https://doi.org/10.1000/J1", None), (2, "arXiv", "2401.2", None, None), (3, "PubMed Central", "PMC3", None, "see 10.1000/J3")], "doc_id long, source string, source_id string, doi string, source_uri string")
    ids = spark.createDataFrame([], "doc_id long, id_type string, id_value string")
    after, counts = storage.enrich(spark, docs, ids, 0)
    assert counts == {"processed": 3, "journal_dois": 2, "arxiv_dois": 2, "total_dois": 3}
    assert storage.docs_without_doi(docs, after).count() == 0
    assert storage.enrich(spark, docs, after, 0)[0].count() == after.count() == 4


def test_full_text_falls_back_to_pdf(spark):
    long = "<p>" + "some words of an article " * 200 + "</p>"

    def html(url):
        if url == "broken":
            raise OSError("gone")
        return long if url == "long" else "<p>abstract only</p>"

    def pdf(url):
        if url == "bad":
            raise ValueError("no pdf")
        return "the text of the file"

    rows = [("1", "long", "x"), ("2", "short", "x"), ("3", "broken", "x"), ("4", "broken", "bad"), ("5", None, None), ("6", "short", None)]
    got = {r.id: (r.origin, r.error) for r in requests.full_texts(spark.createDataFrame(rows, "id string, html_url string, pdf_url string"), html, pdf).collect()}
    assert got == {"1": ("html", None), "2": ("pdf", None), "3": ("pdf", None), "4": (None, "OSError: gone; ValueError: no pdf"), "5": (None, "no full text"), "6": (None, "no full text")}


def test_pages_stop_when_short(spark):
    have = {"a": 25, "b": 20, "c": 3}

    def get(q, start, size):
        n = min(size, max(0, have[q] - start))
        return json.dumps(list(range(n))) if n else None

    q = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "query string")
    got = requests.short_pages(q, get, lambda p: len(json.loads(p)), limit=100, size=10).groupBy("query").count().collect()
    assert {r["query"]: r["count"] for r in got} == {"a": 3, "b": 2, "c": 1}
    assert requests.short_pages(q, get, lambda p: len(json.loads(p)), limit=10, size=10).count() == 3
    assert requests.page_starts(q, 0).count() == 0


def test_lenient_json_of_nothing(spark):
    p = spark.createDataFrame([("",), (None,), ("no json",), ("x [1, 2] y",)], "p string")
    assert [r.a for r in p.select(parsing.lenient_json(F.col("p"), "array<int>").alias("a")).collect()][3] == [1, 2]


def test_catalog(spark):
    spark.range(3).createOrReplaceTempView("some_view")
    assert files.has_table(spark, "some_view") and not files.has_table(spark, "no_such_table")
    assert [r.column for r in files.table_columns(spark, "some_view").collect()] == ["id"]
    assert files.table_columns(spark, "no_such_table").count() == 0
    assert files.setting(spark, "spark.sql.session.timeZone") == "UTC" and files.setting(spark, "no.such.setting", "x") == "x"


TEXTS = ["Studies of horses and the study of a horse", "a horse ran", "no match here", "horses study horses", "The study. " * 5 + "horse"]


@pytest.fixture(scope="module")
def small(spark):
    rows = [(i, i, None, x, [float(i), 1.0]) for i, x in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "chunk_id long, doc_id long, section_name string, text string, embedding array<float>")


@pytest.mark.parametrize("mode", ["and", "or"])
def test_stems_one_by_one_and_batched(spark, small, mode):
    words = "horses studying"
    single = [(r.chunk_id, r.text_score) for r in retrieval.text_matches(small, words, 10, mode, rank="stems").collect()]
    plain = [(i, round(fulltext.rank(v, fulltext.query_lexemes(words), mode), 8)) for i, x in enumerate(TEXTS) if fulltext.matches(v := fulltext.lexemes(x), fulltext.query_lexemes(words), mode)]
    assert single == sorted(plain, key=lambda p: (-p[1], p[0])) and len(single) == (3 if mode == "and" else 4)
    q = spark.createDataFrame([(7, words), (8, "the of"), (9, None)], "query_id long, words string")
    batch = retrieval.batch_matches(small, q, 10, mode, rank="stems").orderBy("text_rank").collect()
    assert [(r.query_id, r.chunk_id, r.text_score) for r in batch] == [(7, i, s) for i, s in single]


def test_stemmed_hybrids(small, t):
    hit = retrieval.hybrid_rrf(small, [0.0, 1.0], "horse studies", 5, rank="stems").collect()
    assert {r.chunk_id for r in hit if r.text_rank is not None} == {0, 3, 4}
    by_words = retrieval.hybrid_rrf(small, [0.0, 1.0], "horse studies", 5).collect()
    assert {r.chunk_id for r in by_words if r.text_rank is not None} == {0}
    both = retrieval.compare(small, t.mentions, [0.0, 1.0], "horse studies", 3, rank="stems").filter("strategy = 'ivfflat_tsvector'").collect()
    assert [r.chunk_id for r in sorted(both, key=lambda r: r.position)] == [r.chunk_id for r in retrieval.hybrid_rrf(small, [0.0, 1.0], "horse studies", 3, rank="stems").collect()]


def test_percentiles_by_counts(spark):
    import random

    rng = random.Random(3)
    for n in (1, 2, 7, 500):
        values = [rng.choice([1.0, 1.0, 2.5, rng.random() * 100, -3.0, None]) for _ in range(n)] + [4.0]
        d = spark.createDataFrame([("g", v) for v in values] + [("none", None)], "g string, v double")
        ok = sorted(v for v in values if v is not None)
        got = {r.g: r for r in evaluation.latency_by_index(d, "g", "v", bins=8).collect()}
        assert (got["g"].median, got["g"].p95, got["g"].p99) == (ok[len(ok) // 2], ok[int(len(ok) * 0.95)], ok[int(len(ok) * 0.99)])
        assert got["none"].median is None and got["none"]["mean"] == 0


def test_index_recall(spark, t, tmp_path):
    """A quarter of the lists holds nine tenths of the exact neighbours where vectors form clusters."""
    import numpy as np

    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 16))
    x = centres[rng.integers(0, 12, 900)] + 0.15 * rng.standard_normal((900, 16))
    c = spark.createDataFrame([(i, i, MODEL, v) for i, v in enumerate(x.tolist())], "chunk_id long, doc_id long, embedding_model string, embedding array<float>")
    index = IvfIndex.build(c, str(tmp_path / "ivf"), suggested_lists(900), file_rows=20)
    assert index.verify().agg(F.sum("rows")).first()[0] == 900
    hits = 0
    for i in range(0, 900, 90):
        exact = {r.chunk_id for r in retrieval.nearest(c, x[i].tolist(), 10).collect()}
        hits += len(exact & {r.chunk_id for r in index.search(x[i].tolist(), 10, suggested_lists(900) // 4).collect()})
    assert hits >= 90


def test_compatible_chunks_of_a_table(spark):
    text = "Introduction\n" + "One two three four. " * 30 + "\nMethods\n" + "Five six seven. " * 30 + "\nResults\nShort end."
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for compat in (False, True):
        rows = chunking.chunk_documents(d, 50, 10, compat=compat).orderBy("chunk_index").collect()
        assert [(r.full_text, r.section_name) for r in rows] == chunking.chunk_text(text, 50, 10, compat)
    # Sections that share a chunk: named by the first of them, or (compat) by the one that closed it.
    sections = [("A", "One two."), ("B", "Three four."), ("C", "Five six seven eight nine ten.")]
    assert [n for _, n in chunking.chunk_sections(sections, 6, 2)] == ["A", "C"]
    assert [n for _, n in chunking.chunk_sections(sections, 6, 2, compat=True)] == ["C", "C"]


def test_composition(spark):
    class Fixed:
        name, dim = "fixed", 2

        def encode(self, texts):
            import numpy as np

            return np.asarray([{"a": [1.0, 0.0], "b": [0.0, 1.0]}.get(x, [0.6, 0.8]) for x in texts])

    r = evaluation.composition(spark.createDataFrame([("a", "b", "a and b")], "a string, b string, both string"), Fixed()).first()
    assert (r.sum_to_both, r.first_to_both, r.second_to_both) == (pytest.approx(1.4 / 2**0.5, abs=1e-5), pytest.approx(0.6), pytest.approx(0.8))


def test_pdf_rows_have_errors_or_text(spark, tmp_path):
    from ragspark.sources import pdf

    (tmp_path / "a.pdf").write_bytes(b"not a pdf")
    rows = pdf.pdf_files(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0].text is None and rows[0].error


def test_averages(spark):
    d = spark.createDataFrame([(0.5,), (1.0,), (0.0,)], "p double")
    r = evaluation.averages(d, "p").first()
    assert (r.avg_p, r.min_p, r.max_p) == (0.5, 0.0, 1.0)


def test_centroids_are_fitted_without_a_task_a_list(spark, tmp_path):
    """The distances of all pairs of centroids went to the driver at each step, in a task a centroid."""
    import numpy as np

    x = np.random.default_rng(2).normal(size=(900, 64))
    c = spark.createDataFrame([(i, i, "m", [float(v) for v in r]) for i, r in enumerate(x)], "chunk_id long, doc_id long, embedding_model string, embedding array<double>")
    spark.sparkContext.setJobGroup("fitting", "")
    index = IvfIndex.build(c, str(tmp_path / "ivf"), 200)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("fitting") for s in tracker.getJobInfo(j).stageIds]
    # The index's list of centroids, a local table, has a task a row at most; what is fitted has a task a file.
    assert stages and max(s.numTasks for s in stages if s and s.name.startswith("collect at")) < 20
    assert index.rows().count() == 900 and len(index.centroids) <= 200
