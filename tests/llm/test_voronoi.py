"""The Voronoi top-k join against brute force, its pruning on clustered vectors, and hostile input."""

import dataclasses

import numpy as np
import pytest

from ragspark.llm import voronoi
from ragspark.llm.voronoi import Settings

FIELDS = "vec_id long, embedding array<double>, score int, g string"
SMALL = Settings(k=3, per_pivot=4, rings=4, queries=8, least_queries=2, chunk=16, strip=4)


def brute(rows, k, every=20):
    """{query: [(score, vec_id)]} by plain Python integers."""
    import math

    seen = {}
    for i, x in rows:
        if i is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        if i not in seen or list(x) < seen[i]:
            seen[i] = list(x)
    ints = {i: [math.floor(64 * c) if abs(c) < 1e300 else 64 * int(c) for c in x] for i, x in seen.items()}
    out = {}
    for q, a in ints.items():
        if q % every == 0:
            s = [(max(min(sum(x * y for x, y in zip(a, b)), 2**63 - 1), -(2**63)), i) for i, b in ints.items() if i != q]
            out[q] = sorted(s, key=lambda t: (-t[0], t[1]))[:k]
    return {q: s for q, s in out.items() if s}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        got = out.setdefault(r.query_id, [])
        got.append((r.score, r.vec_id))
        assert r.rank == len(got)
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, x, 7, "g") for i, x in rows], FIELDS)


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_brute_force_with_ties_copies_and_norms(spark, scratch, seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((400, 6)) * rng.choice([0.05, 1.0, 4.0], (400, 1))
    x[100:230] = x[0]  # a third are copies
    x[300:320] = np.round(x[300:320])
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(rng.permutation(400), x, strict=True)]
    assert found(voronoi.search(spark, table(spark, rows), scratch, settings=SMALL)) == brute(rows, 3)


def test_hostile_vectors(spark, scratch):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [0.0, 0.0]), (40, []), (60, [1e30, -1.0]), (80, [1e308, 1.0]), (1, [nan, 1.0]), (2, [inf, 0.0]), (3, None), (4, [1.0, None]), (None, [1.0, 1.0]), (5, [1.0]), (6, [1.0, 2.0, 3.0]), (7, [-0.001, 0.999]), (8, [1.0, 2.0]), (8, [0.5, 9.0]), (9, [1.0, 2.0]), (9, [1.0, 2.0]), (-20, [3.0, 0.0])]
    got = found(voronoi.search(spark, table(spark, rows), scratch, settings=SMALL))
    want = brute(rows, 3)
    # A component that overflows as 64 * x is held at the largest double, so only its order is asked for.
    assert {q: [i for _, i in s] for q, s in got.items() if q != 80} == {q: [i for _, i in s] for q, s in want.items() if q != 80}
    assert got[0] == want[0] and got[40] == want[40] and got[60][0][0] == 2**63 - 1 and 80 in got


def test_empty_alone_and_without_queries(spark, scratch):
    for rows in ([], [(1, [1.0])], [(20, [1.0])], [(20, None)]):
        assert voronoi.search(spark, table(spark, rows), scratch).count() == 0


def test_clusters_are_pruned_and_nothing_is_lost():
    """The bounds alone: every true neighbour's ring is needed, most rings of other clusters are not."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 16)) * 8
    x = np.floor(64 * (centres[rng.integers(0, 20, 4000)] + 0.05 * rng.standard_normal((4000, 16))))
    rows = [voronoi.packed(v) for v in x]
    settings = dataclasses.replace(Settings(), k=10)
    pivots = voronoi.choose_pivots(rows[:1000], 40, 1)
    cell, far = voronoi.nearest_pivot(x, pivots)
    ring = np.minimum(far / voronoi.ring_width(rows[:1000], pivots, settings.rings), settings.rings - 1).astype(int)
    summary = []
    for query, at in ((True, np.arange(0, 4000, 20)), (False, np.arange(4000))):
        for c, r in sorted({(cell[i], ring[i]) for i in at}):
            own = at[(cell[at] == c) & (ring[at] == r)]
            square = voronoi.squares(x[own])
            summary.append({"query": query, "cell": c, "ring": r, "n": len(own), "least": far[own].min() - 1e-6, "far": far[own].max() + 1e-6, "small": square.min(), "most": square.max()})
    p = voronoi.plan(pivots, summary, dataclasses.replace(settings, queries=20, least_queries=5))
    needed = read = 0
    for q in range(0, 4000, 20):
        g = p.of_cell[cell[q]]
        scores = x @ x[q]
        scores[q] = -np.inf
        top = np.argsort(-scores, kind="stable")[: settings.k]
        assert p.needs[cell[top] * settings.rings + ring[top], g].all()
        read += p.needs[cell * settings.rings + ring, g].sum()
        needed += 4000
    assert read < 0.35 * needed
