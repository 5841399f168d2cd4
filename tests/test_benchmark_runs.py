"""The strategies' benchmark: sampled questions, a stored run, comparisons against plain code."""

import pytest

from ragspark.operators import benchmark, retrieval
from ragspark.plans.derived import MODEL, Tables


@pytest.fixture(scope="module")
def ran(spark, sf_dir, tmp_path_factory):
    t = Tables(spark, sf_dir)
    q = benchmark.sampled_questions(retrieval.of_model(t.chunks, MODEL), 7)
    path = str(tmp_path_factory.mktemp("runs"))
    return t, path, benchmark.run(t.chunks, t.mentions, q, path, 5, MODEL, t.word_index).first()


def test_questions(spark, sf_dir):
    chunks = Tables(spark, sf_dir).chunks
    q = benchmark.sampled_questions(chunks, 9).collect()
    assert len(q) == 9 and all(len(r.words) > 1 and r.words.endswith(".") and len(r.vector) == 64 for r in q)
    assert [r.query_id for r in q] == [r.query_id for r in benchmark.sampled_questions(chunks, 9).collect()]
    assert {r.query_id for r in q} != {r.query_id for r in benchmark.sampled_questions(chunks, 9, seed=1).collect()}
    assert benchmark.sampled_questions(chunks.filter("false"), 9).count() == 0


def test_a_stored_run(spark, ran):
    _, path, r = ran
    assert (r.num_queries, r.top_k, r.embedding_model) == (7, 5, MODEL) and set(r.strategy_metrics) == set(retrieval.STRATEGIES)
    assert all(m.avg_latency_ms > 0 and m.queries == 7 for m in r.strategy_metrics.values()) and r.strategy_metrics["ivfflat_only"].results == 35
    again = benchmark.stored_run(spark, path).first()
    assert again == r and set(r.comparisons) == set(retrieval.STRATEGIES[1:])
    rows = {x.strategy: x for x in benchmark.table(benchmark.stored_run(spark, path)).collect()}
    assert rows["ivfflat_only"].avg_overlap is None and rows["ivfflat_ner_boost"].avg_overlap == r.comparisons["ivfflat_ner_boost"].avg_overlap


def test_comparisons_against_sets(spark, ran):
    _, path, r = ran
    lists = {}
    for x in benchmark.stored_lists(spark, path).collect():
        lists.setdefault(x.strategy, {}).setdefault(x.query_id, {})[x.chunk_id] = x["rank"]
    base = lists["ivfflat_only"]
    for name in retrieval.STRATEGIES[1:]:
        shares = [len(base[q].keys() & lists[name][q].keys()) / len(base[q].keys() | lists[name][q].keys()) for q in base]
        c = r.comparisons[name]
        assert c.avg_overlap == pytest.approx(sum(shares) / len(shares), abs=2e-6) and c.min_overlap == pytest.approx(min(shares), abs=1e-6) and c.max_overlap == pytest.approx(max(shares), abs=1e-6)


def test_unknown_strategy(ran):
    with pytest.raises(ValueError, match="no strategy"):
        benchmark.strategy_list("x", None, None, None, 1)


def test_strategies_share_their_searches(spark, sf_dir, tmp_path, monkeypatch):
    """All the questions were searched by vector four times, and by text twice."""
    t, searched = Tables(spark, sf_dir), []
    q = benchmark.sampled_questions(t.chunks, 6)
    apart = {n: benchmark.strategy_list(n, t.chunks, t.mentions, q, 5, t.word_index).collect() for n in retrieval.STRATEGIES}
    for name in ("batch_nearest", "batch_matches"):
        plain = getattr(retrieval, name)
        monkeypatch.setattr(retrieval, name, lambda *a, _f=plain, _n=name, **k: searched.append(_n) or _f(*a, **k))
    got = benchmark.strategy_lists(t.chunks, t.mentions, q, str(tmp_path), 5, t.word_index)
    assert {n: sorted(x.collect()) for n, x in got.items()} == {n: sorted(x) for n, x in apart.items()} and searched == ["batch_nearest", "batch_matches"]
