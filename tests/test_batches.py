"""Batched search beyond one block of queries, and what rests on it."""

import numpy as np
import pytest

from ragspark.operators import evaluation, retrieval
from ragspark.plans import reference_queries
from ragspark.plans.derived import Tables


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 64))
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "chunk_id long, embedding array<double>")


def same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("most", [7, 30, 89])
def test_blocks_of_queries(spark, vectors, most):
    q = vectors.selectExpr("chunk_id as query_id", "embedding as vector")
    assert same(retrieval.batch_nearest(vectors, q, 5, most), retrieval.batch_nearest(vectors, q, 5))
    assert same(retrieval.self_neighbours(vectors, 5, most), retrieval.self_neighbours(vectors, 5))
    assert retrieval.batch_nearest(vectors, q.limit(0), 5).count() == 0


def test_best_places_with_ties():
    rng = np.random.default_rng(6)
    for n in (1, 9, 50, 400):
        q, s, ids = rng.integers(0, 3, n), rng.integers(0, 12, n) / 10, rng.permutation(n)
        want = [i for k in range(3) for i in np.lexsort((ids, -s, q != k))[: min(5, int((q == k).sum()))]]
        assert retrieval.best_places(q, ids, s, 5).tolist() == want
    assert retrieval.best_places(q[:0], ids[:0], s[:0], 5).tolist() == []


def test_odd_vectors_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0, None]), (5, [1.0]), (6, [1.0, 1.0])]
    c = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0]), (8, None)], "query_id long, vector array<double>")
    assert [(r.query_id, r.chunk_id) for r in retrieval.batch_nearest(c, q, 5).orderBy("rank").collect()] == [(9, 1), (9, 6), (9, 2)]


def test_vectors_without_direction_take_no_part_in_either_search(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, i / 10]) for i in range(6)] + [(10, [nan, 1.0]), (11, [inf, 1.0]), (12, [0.0, 0.0]), (13, None), (14, [None, 1.0]), (15, []), (16, [1.0, 2.0, 3.0])]
    c = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").selectExpr("*", "chunk_id as doc_id")
    q = c.selectExpr("chunk_id + 100 as query_id", "embedding as vector")
    two = q.filter("size(vector) = 2")
    one = {r.chunk_id: r.similarity for r in retrieval.nearest(c.filter("coalesce(size(embedding), 2) = 2"), [1.0, 0.2], 5).collect()}
    assert list(one) == [2, 3, 1, 4, 0]
    for got in (retrieval.batch_nearest(c, two, 5), retrieval.batch_nearest(c, two, 5, 1), retrieval.batch_nearest(c, q.filter("query_id <> 116"), 5)):
        rows = got.collect()
        assert {r.query_id for r in rows} == set(range(100, 106)) and len(rows) == 30
        assert {r.chunk_id: r.similarity for r in rows if r.query_id == 102} == one
    assert {(r.query_id, r.chunk_id) for r in retrieval.batch_nearest(c, q, 5).collect() if r.query_id == 116} == {(116, 16)}


def test_grid_of_many_blocks(spark, vectors):
    q = vectors.selectExpr("chunk_id as query_id", "embedding as vector")
    got = retrieval.best_by_query(retrieval.grid_nearest(vectors, q, 4, query_rows=20, chunk_rows=13), 4)
    assert same(got, retrieval.batch_nearest(vectors, q, 4))


def test_ablation_against_plain(spark, vectors):
    x = np.asarray([r.embedding for r in vectors.orderBy("chunk_id").collect()])

    def nearest(v):
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        s = np.round(v @ v.T, 6)
        return {(q, int(c)) for q in range(0, 90, 20) for c in [c for c in np.lexsort((np.arange(90), -s[q])) if c != q][:10]}

    whole, shares = nearest(x), []
    for t in range(6):
        take = sorted(np.random.default_rng(t).choice(64, round(0.6 * 64), replace=False).tolist())
        shares.append(len(whole & nearest(x[:, take])) / len(whole))
    got = evaluation.ablation(vectors, 0.6)
    assert got["mean"] == pytest.approx(np.mean(shares)) and got["std"] == pytest.approx(np.std(shares)) and got["std"] > 0


def test_ablation_query_is_whole(spark, sf_dir):
    rows = reference_queries.queries()["ablation_overlap"](spark, sf_dir).collect()
    assert [r.keep for r in rows] == [0.8, 0.6, 0.4, 0.2] and all(r.std > 0 for r in rows)


def test_ablation_query_asks_for_all_vectors(spark, sf_dir):
    """Shares came from every twentieth vector's neighbours."""
    rows = Tables(spark, sf_dir).chunks.select("chunk_id", "embedding").orderBy("chunk_id").collect()
    ids, x = np.asarray([r.chunk_id for r in rows]), np.asarray([r.embedding for r in rows], float)

    def nearest(v):
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        s = np.round(v @ v.T, 6)
        return {(q, int(c)) for q in range(len(v)) for c in [c for c in np.lexsort((ids, -s[q])) if c != q][:10]}

    whole = nearest(x)
    for r in reference_queries.queries()["ablation_overlap"](spark, sf_dir).collect():
        shares = [len(whole & nearest(x[:, evaluation.kept_dimensions(r.keep, t)])) / len(whole) for t in range(6)]
        assert r.mean == pytest.approx(np.mean(shares)) and r.std == pytest.approx(np.std(shares))


@pytest.mark.parametrize("rows", [16, 4096])
def test_many_ablations_are_counted_by_blocks(spark, vectors, monkeypatch, rows):
    """All that was found, 275 rows a vector, was shuffled and stored. Copies, null, zero and other vectors beside."""
    odd = [(100, None), (101, [0.0] * 64), (102, [1.0]), (103, [float("nan")] * 64), (104, [None] * 64)]
    v = vectors.union(vectors.filter("chunk_id < 30").selectExpr("chunk_id + 200", "embedding")).union(spark.createDataFrame(odd, vectors.schema))
    v = v.union(vectors.filter("chunk_id < 1").selectExpr("explode(sequence(300, 315)) as chunk_id", "embedding"))
    want = evaluation.ablations(v, (0.6, 0.1), 2, every=1)
    monkeypatch.setattr(evaluation, "FEW_ASKED", 20)
    monkeypatch.setattr(retrieval, "QUERY_ROWS", 16)
    monkeypatch.setattr(retrieval.blocks_of_parts, "__defaults__", (rows,))
    monkeypatch.setattr(retrieval, "batch_nearest", None)
    assert evaluation.ablations(v, (0.6, 0.1), 2, every=1) == want and want[1]["std"] > 0
    assert evaluation.ablations(v, (0.6, 0.1), 2, every=3) != want


def test_probes_are_handed_on_in_parts(spark, tmp_path, monkeypatch):
    """A batch of queries times its lists was one batch of their vectors."""
    import numpy as np
    import pyarrow as pa

    from ragspark.operators import ivf

    rng, taken = np.random.default_rng(1), {}
    index = ivf.IvfIndex(spark, str(tmp_path), rng.normal(size=(400, 4)))
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "query_id long, vector array<double>")
    monkeypatch.setattr(type(df), "mapInArrow", lambda df, each, schema: taken.update(each=each))
    index.probes(df, 300)
    x = rng.normal(size=(1000, 4))
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(x.tolist())], names=["query_id", "vector"])
    parts = list(taken["each"](iter([batch])))
    assert max(p.num_rows for p in parts) <= ivf.PROBE_ROWS
    got = [(q, i) for p in parts for q, i in zip(p.column("query_id").to_pylist(), p.column("list_id").to_pylist(), strict=True)]
    assert got == [(q, int(i)) for q, row in enumerate(ivf.nearest_lists(ivf.unit_rows(x)[0], index.centroids, 300)) for i in row]


def test_best_of_against_sorted(monkeypatch):
    """Single precision only rules out: near ties, copies, rows without a direction and small batches give the sorted lists."""
    monkeypatch.setattr(retrieval, "QUERY_ROWS", 8)
    monkeypatch.setattr(retrieval, "CHUNK_ROWS", 50)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(300, 16)), np.zeros((5, 16)), np.full((3, 16), np.nan)])
    near = x[:40].copy()
    near[:, 0] += rng.normal(size=40) * 1e-6
    x = np.concatenate([x, x[:30], near])[rng.permutation(378)]
    ids = rng.permutation(len(x)) + 7
    m, good = retrieval.unit_rows(x)
    for k in (1, 11, 500):
        best = retrieval.BestOf(ids[good][:20], m[:20], k)
        for s in range(0, len(x), 71):
            best.feed(ids[s : s + 71], x[s : s + 71])
        got = sorted(zip(*(c.to_pylist() for c in best.found().columns), strict=True))
        want = [(int(ids[good[q]]), int(ids[good[c]]), float(x_q[c])) for q in range(20) for x_q in [np.round(m @ m[q], 6)] for c in np.lexsort((ids[good], -x_q))[:k]]
        assert [g[:2] for g in got] == sorted(w[:2] for w in want) and np.allclose([g[2] for g in got], [w[2] for w in sorted(want)], atol=1.1e-6)


def test_ablations_are_one_pass(spark, vectors, monkeypatch):
    """Each trial searched all vectors again."""
    searched = []
    plain = retrieval.batch_nearest
    monkeypatch.setattr(retrieval, "batch_nearest", lambda *a, **k: searched.append(1) or plain(*a, **k))
    got = evaluation.ablations(vectors, (0.6, 0.3), 3)
    assert len(searched) == 1 and got == [evaluation.ablation(vectors, keep, 3) for keep in (0.6, 0.3)]


def test_parts_by_the_grid(spark, vectors):
    q = vectors.selectExpr("chunk_id as query_id", "embedding as vector")
    parts = [list(range(64)), [3, 5, 8, 13, 21]]
    got = retrieval.best_by_query(retrieval.grid_nearest(vectors, q, 4, query_rows=20, chunk_rows=13, parts=parts), 4, "part")
    assert same(got, retrieval.batch_nearest(vectors, q, 4, parts=parts)) and got.count() > 90 * 4
