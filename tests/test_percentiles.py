"""Percentiles by counts against sorted lists: outliers, ties, signs, tiny and infinite values."""

import math
import random

import pytest

from ragspark.operators import evaluation

KINDS = {
    "outlier": lambda r: [r.uniform(0, 100) for _ in range(500)] + [1e9],
    "ties": lambda r: [float(r.randint(0, 3)) for _ in range(400)],
    "signs": lambda r: [r.uniform(-1, 1) * 10 ** r.randint(-300, 300) for _ in range(300)] + [0.0, -0.0],
    "near": lambda r: [1 + r.random() * 1e-9 for _ in range(300)],
    "powers": lambda r: [2.0 ** r.randint(-60, 60) * r.choice([1, 1 - 1e-16, 1 + 2e-16]) for _ in range(300)],
    "one": lambda r: [7.5],
    "two": lambda r: [1.0, 2.0],
    "infinite": lambda r: [math.inf, -math.inf, 1.0, 2.0, 3.0, math.inf],
    "tiny": lambda r: [5e-324 * r.randint(0, 9) for _ in range(50)],
}


@pytest.fixture(scope="module")
def values():
    rng = random.Random(4)
    return {k: f(rng) for k, f in KINDS.items()}


def test_places_of_all_kinds(spark, values):
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("one", None), ("one", math.nan), ("none", None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    F = evaluation.F
    got = {r.g: r for r in evaluation.values_at(df, "g", "v", {"low": F.lit(0), "mid": F.expr("_n div 2"), "p95": F.floor(F.col("_n") * 0.95), "top": F.col("_n") - 1, "over": F.col("_n")}, bins=8).collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        s, n = sorted(vs), len(vs)
        assert (got[k].low, got[k].mid, got[k].p95, got[k].top, got[k].over) == (s[0], s[n // 2], s[int(n * 0.95)], s[-1], None), k


def test_interpolated(spark, values):
    import numpy as np

    kinds = {k: v for k, v in values.items() if k in ("outlier", "ties", "near", "one", "two")}
    df = spark.createDataFrame([(k, v) for k, vs in kinds.items() for v in vs], "g string, v double")
    for r in evaluation.latency_linear(df, "g", "v").collect():
        for name, p in (("p5", 5), ("median", 50), ("p95", 95)):
            assert r[name] == pytest.approx(float(np.percentile(kinds[r.g], p)), abs=2e-6), (r.g, name)


def test_an_outlier_does_not_gather_the_rest(spark):
    df = spark.range(20_000).selectExpr("'g' as g", "double(id % 1000) / 10 + 1 as v").unionByName(spark.createDataFrame([("g", 1e12)], "g string, v double"))
    bins = df.withColumn("b", evaluation.magnitude_bin(evaluation.F.col("v"))).groupBy("b").count().agg({"count": "max", "b": "count"}).first()
    assert bins["max(count)"] < 0.03 * 20_000 and bins["count(b)"] > 300
