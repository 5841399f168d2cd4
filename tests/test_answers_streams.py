"""Batched answers, the paged source and late feedback, each against plain code and with what goes wrong."""

import json
import time
from datetime import datetime, timedelta
from pathlib import Path

import pytest

from ragspark.operators import answers
from ragspark.operators.filters import Filters
from ragspark.plug import ExtractiveGenerator
from ragspark.sources import paged
from ragspark.streaming import feedback

CHUNKS = "chunk_id long, doc_id long, chunk_index int, text string, embedding array<double>, embedding_model string"


@pytest.fixture
def corpus(spark):
    chunks = spark.createDataFrame([(i, i // 2, i % 2, f"Text {i} here. More" if i != 3 else None, [1.0, i / 10], "m") for i in range(8)], CHUNKS)
    docs = spark.createDataFrame([(i, f"pmcid://pmc{i}" if i % 2 == 0 else f"arxiv://{i}", "arXiv" if i % 2 else "PubMed Central") for i in range(4)], "doc_id long, ext_id string, source string")
    return chunks, docs


def test_answers_and_citations(spark, corpus):
    class Saying:
        """A generator of many prompts at a time; answers with what the question says."""

        def generate_many(self, system, prompts):
            return [p.split("Question: ")[1].split("\n")[0] for p in prompts]

    chunks, docs = corpus
    asked = [(1, "See [PMC0#0] and [PMC0: 1] and [PMC99#1]", [1.0, 0.0]), (2, "nothing is cited", [1.0, 0.7]), (3, None, [1.0, 0.0]), (4, "no vector [PMC0#0]", None), (5, "[pmc0#1] [PMC0#1]", [1.0, 0.0])]
    got = {r.query_id: r for r in answers.answer_many(spark.createDataFrame(asked, "query_id long, question string, vector array<double>"), chunks, docs, Saying(), 3).collect()}
    cited = {q: [(c.position, c.chunk_id, c.doc_ref, c.chunk_index) for c in r.citations] for q, r in got.items()}
    assert cited == {1: [(1, 0, "PMC0", 0), (2, 1, "PMC0", 1)], 2: [(1, 7, "3", 1)], 3: [(1, 0, "PMC0", 0)], 4: [], 5: [(1, 1, "PMC0", 1)]}
    assert got[4].answer is None and got[4].n_contexts == 0 and got[1].n_contexts == 3
    with pytest.raises(ValueError, match="15"):
        answers.answer_many(spark.createDataFrame(asked, "query_id long, question string, vector array<double>"), chunks, docs, Saying(), 16)


def test_answers_filtered_and_default_generator(spark, corpus):
    chunks, docs = corpus
    asked = spark.createDataFrame([(1, "q", [1.0, 0.0])], "query_id long, question string, vector array<double>")
    r = answers.answer_many(asked, chunks, docs, ExtractiveGenerator(), 2, Filters(sources=["arXiv"])).first()
    assert r.answer == "Text 2 here. [1#0]" and [c.chunk_id for c in r.citations] == [2]
    assert answers.answer_many(asked, chunks, docs, ExtractiveGenerator(), 2, Filters(sources=["none"])).first().answer is None


class Recorded:
    """Results from a folder, a file a query; writes down what it was asked and when, and fails once a page if told so."""

    def __init__(self, place, failing=False, told=True):
        self.place, self.failing, self.told = Path(place), failing, told

    def results(self, query):
        return json.loads((self.place / f"{query}.json").read_text())

    def total(self, query):
        return len(self.results(query)) if self.told else None

    def page(self, query, start, size):
        asked = self.place / f"asked-{query}-{start}-{time.time_ns()}"
        asked.touch()
        if self.failing and len(list(self.place.glob(f"asked-{query}-{start}-*"))) == 1:
            raise OSError("try again")
        return self.results(query)[start : start + size]


def options(place, **more):
    fetcher = {"fetcher": f"{__name__}:Recorded", "fetcher_options": json.dumps({"place": str(place), **more.pop("given", {})})}
    return {"queries": json.dumps(["a", "b", None, "none"]), "page_size": "4", "limit": "10"} | fetcher | {k: str(v) for k, v in more.items()}


@pytest.fixture
def recorded(spark, tmp_path, monkeypatch):
    import os

    monkeypatch.setenv("PYTHONPATH", f"{Path(__file__).parent}:{os.environ.get('PYTHONPATH', '')}")
    (tmp_path / "a.json").write_text(json.dumps([f"a{i}" for i in range(13)]))
    (tmp_path / "b.json").write_text(json.dumps([f"b{i}" for i in range(5)]))
    (tmp_path / "none.json").write_text("[]")
    paged.register(spark)
    return tmp_path


def rows_of(service):
    return [r for run in service.runs([(q, 0, service.pages_of(q)) for q in service.queries]) for r in service.rows(run)]


@pytest.mark.parametrize("given, a_task", [({}, 1), ({"failing": True}, 1), ({"told": False}, 3), ({"told": False}, 1)])
def test_pages_limits_and_retries(recorded, given, a_task):
    service = paged._Service(options(recorded, given=given, pages_a_task=a_task))
    got = rows_of(service)
    assert got == [("a", i // 4, i, f"a{i}") for i in range(10)] + [("b", i // 4, i, f"b{i}") for i in range(5)]
    if a_task == 3:  # a short page ends the run: b's third page and the second of none are not asked for
        assert not list(recorded.glob("asked-b-8-*")) and not list(recorded.glob("asked-none-4-*"))
    if not given:
        assert len(service.runs([("a", 0, 3)])) == 3


def test_rate_is_shared(recorded):
    service = paged._Service(options(recorded, rate=50, pages_a_task=2))
    slots = [run.not_before + i * run.apart for run in service.runs([("a", 0, 3), ("b", 0, 2)]) for i in range(run.count)]
    assert all(b - a == pytest.approx(0.02) for a, b in zip(slots, slots[1:], strict=False)) and len(slots) == 5
    began = time.time()
    rows_of(service)
    assert time.time() - began > 0.08


def test_a_service_that_stays_down_fails(recorded):
    service = paged._Service(options(recorded, retries=0, given={"failing": True}))
    with pytest.raises(OSError, match="again"):
        rows_of(service)


def test_read_as_a_table_and_as_a_stream(spark, tmp_path):
    paged.register(spark)
    given = {"queries": json.dumps(["x", "y"]), "fetcher_options": json.dumps({"totals": {"x": 9, "y": 2}}), "page_size": "2", "limit": "7"}
    df = spark.read.format("paged_search").options(**given).load()
    want = sorted([("x", i // 2, i, f"x#{i}") for i in range(7)] + [("y", 0, i, f"y#{i}") for i in range(2)])
    assert sorted(map(tuple, df.collect())) == want and df.rdd.getNumPartitions() == 5
    for _ in range(2):  # the second run finds all pages done
        stream = spark.readStream.format("paged_search").options(**given, pages_a_batch="2").load()
        q = stream.writeStream.foreachBatch(feedback.committed(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
        try:
            for _ in range(60):
                q.processAllAvailable()
                if sorted(map(tuple, feedback.read_committed(spark, str(tmp_path / "out"), paged.SCHEMA).collect())) == want:
                    break
                time.sleep(0.5)
        finally:
            q.stop()
        assert sorted(map(tuple, feedback.read_committed(spark, str(tmp_path / "out"), paged.SCHEMA).collect())) == want


T0 = datetime(2024, 1, 1)
TURN = "experiment_id string, ts timestamp"
BACK = "experiment_id string, ts timestamp, clicked_chunk_ids array<long>, user_rating int"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def test_late_repeated_and_missing_feedback(spark, tmp_path):
    turns = [("a", at(0)), ("b", at(1)), ("c", at(2)), ("d", at(3)), ("a2", at(50))]
    back = [("a", at(30), [1], 5), ("a", at(40), [2], 1), ("b", at(200), [3], 2), ("zz", at(5), [], 1), ("a2", at(50), None, 3)]
    want = [("a", 5), ("a2", 3), ("b", None), ("c", None), ("d", None)]
    batch = feedback.with_late_feedback(spark.createDataFrame(turns, TURN), spark.createDataFrame(back[:1] + back[2:], BACK))
    assert sorted((r.experiment_id, r.user_rating) for r in batch.collect()) == want

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    def run():
        streams = [spark.readStream.schema(s).parquet(str(tmp_path / n)) for n, s in (("turns", TURN), ("back", BACK))]
        joined = feedback.with_late_feedback(*streams)
        feedback.start(joined, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return sorted((r.experiment_id, r.user_rating) for r in feedback.read_committed(spark, str(tmp_path / "out"), joined.schema).collect())

    put("turns", turns, TURN)
    put("back", [back[0]], BACK)
    assert ("a", 5) in run()
    put("back", back[1:], BACK)
    put("turns", [("end", at(5000))], TURN)
    put("back", [("end", at(5000), None, 0)], BACK)
    for _ in range(2):
        got = [x for x in run() if x[0] != "end"]
    assert got == want


def test_replayed_batches_change_nothing(spark, tmp_path):
    write = feedback.committed(str(tmp_path / "c"))
    for number, rows in ((0, 3), (1, 2), (1, 2), (0, 3)):
        write(spark.range(rows), number)
    assert feedback.read_committed(spark, str(tmp_path / "c"), "id long").count() == 5
    seen = []
    work = feedback.once(lambda b: seen.append(b.count()), str(tmp_path / "o"))
    for number in (0, 0, 1, 0, 1, 2):
        work(spark.range(number + 1), number)
    assert seen == [1, 2, 3]

    def failing(batch):
        raise OSError("down")

    with pytest.raises(OSError, match="down"):
        feedback.once(failing, str(tmp_path / "o"))(spark.range(1), 3)
    work(spark.range(9), 3)
    assert seen[-1] == 9
