"""Evaluation of result lists, latencies and embeddings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import own_folder


def overlap(a: DataFrame, b: DataFrame, key: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """query_id, n_a, n_b, n_both: sizes of the two lists' sets and of what they share."""
    x = a.select(key, item).distinct().withColumn("_a", F.lit(1))
    y = b.select(key, item).distinct().withColumn("_b", F.lit(1))
    j = x.join(y, [key, item], "full_outer")
    return j.groupBy(key).agg(F.count("_a").alias("n_a"), F.count("_b").alias("n_b"), F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("n_both"))


def jaccard(n_a: Column, n_b: Column, n_both: Column) -> Column:
    """H1: of two empty lists 1."""
    return F.when(n_a + n_b == 0, F.lit(1.0)).otherwise(n_both / F.greatest(n_a + n_b - n_both, F.lit(1)))


def recall(n_exact: Column, n_both: Column) -> Column:
    """H2: 0 without exact results."""
    return F.when(n_exact == 0, F.lit(0.0)).otherwise(n_both / n_exact)


def precision_recall(retrieved: DataFrame, truth: DataFrame, key: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """I44."""
    o = overlap(retrieved, truth, key, item)
    p = F.when((F.col("n_a") == 0) & (F.col("n_b") == 0), F.lit(1.0)).when(F.col("n_a") == 0, F.lit(0.0)).otherwise(F.col("n_both") / F.col("n_a"))
    r = F.when((F.col("n_a") == 0) & (F.col("n_b") == 0), F.lit(1.0)).when(F.col("n_b") == 0, F.lit(0.0)).otherwise(F.col("n_both") / F.col("n_b"))
    o = o.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") == 0, F.lit(0.0)).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return o.withColumn("f1", f1).select(key, *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def averages(metrics: DataFrame, *names: str) -> DataFrame:
    """E16."""
    return metrics.agg(*[F.round(f(n), 6).alias(f"{k}_{n}") for n in names for k, f in (("avg", F.avg), ("min", F.min), ("max", F.max))])


def rank_correlation(a: DataFrame, b: DataFrame, key: str = "query_id", item: str = "chunk_id", rank: str = "rank") -> DataFrame:
    """By places in the whole lists; fewer than two common items give 0. May leave [-1, 1]."""
    keys = a.select(key).union(b.select(key)).distinct()
    j = a.select(key, item, F.col(rank).alias("_x")).join(b.select(key, item, F.col(rank).alias("_y")), [key, item])
    n = F.count(F.lit(1)).cast("double")
    c = j.groupBy(key).agg(F.when(n >= 2, 1 - 6 * F.sum((F.col("_x") - F.col("_y")) ** 2) / (n * (n * n - 1))).otherwise(F.lit(0.0)).alias("_c"))
    return keys.join(c, key, "left").select(key, F.round(F.coalesce("_c", F.lit(0.0)), 6).alias("rank_correlation"))


def magnitude_bin(v: Column) -> Column:
    """Bins in the order of the values, each a 256th of a power of two wide: no value, however far off, widens another's."""
    size = F.abs(v)
    power = F.floor(F.log2(size))
    at = (power + 1100) * 256 + F.floor((size / F.pow(F.lit(2.0), power) - 1) * 256)
    at = F.when(size == float("inf"), F.lit(10_000_000)).otherwise(at).cast("long")
    return F.when(v == 0, F.lit(0)).when(v > 0, at + 1).otherwise(-at - 1).cast("long")


def values_at(df: DataFrame, group: str, value: str, places: dict[str, Column], bins: int = 4096) -> DataFrame:
    """group and, for each name, the group's value at that place (from 0) of its sorted values; places are columns over the number `_n` of values.

    Bins by magnitude, then equal bins within those that hold a place, are counted; only the values of
    the bins found are counted one by one. So no task sorts or gathers a group, whatever its outliers.
    Nulls and NaN are no values.
    """
    v = df.select(group, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    v = v.withColumn("_b", magnitude_bin(F.col("_v")))

    def inside(rows: DataFrame, wanted: DataFrame, keys: list[str], order: str) -> DataFrame:
        """Which of the ordered rows (with a count) holds each wanted place of its keys, and the place within it."""
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        j = rows.withColumn("_upto", F.sum("_c").over(w)).join(wanted, keys)
        return j.filter((F.col("_at") >= F.col("_upto") - F.col("_c")) & (F.col("_at") < F.col("_upto"))).withColumn("_at", F.col("_at") - F.col("_upto") + F.col("_c")).drop("_c", "_upto")

    count = F.count(F.lit(1)).alias("_c")
    first = v.groupBy(group, "_b").agg(count, F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    sizes = first.groupBy(group).agg(F.sum("_c").alias("_n"))
    named = F.array(*[F.struct(F.lit(n).alias("_name"), at.cast("long").alias("_at")) for n, at in places.items()])
    wanted = sizes.select(group, F.explode(named).alias("_p")).select(group, "_p.*")
    coarse = inside(first, wanted, [group], "_b").select(group, "_b", "_lo", "_hi", "_name", "_at")
    share = (F.col("_v") - F.col("_lo")) / F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo"))
    v = v.join(coarse.select(group, "_b", "_lo", "_hi").distinct(), [group, "_b"]).withColumn("_f", F.least(F.lit(bins - 1), F.floor(F.coalesce(share, F.lit(0.0)) * bins)).cast("int"))
    fine = inside(v.groupBy(group, "_b", "_f").agg(count), coarse.drop("_lo", "_hi"), [group, "_b"], "_f")
    keys = [group, "_b", "_f"]
    few = v.join(fine.select(*keys).distinct(), keys, "left_semi").groupBy(*keys, "_v").agg(count)
    found = inside(few, fine, keys, "_v")
    return found.groupBy(group).agg(*[F.max(F.when(F.col("_name") == n, F.col("_v"))).alias(n) for n in places])


def percentiles(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """group and, for each name, the percentile between the two values that lie around its place, to 6 digits."""
    at = lambda p: F.lit(p) * (F.col("_n") - 1)
    both = {f"{n}_{side}": f(at(p)) for n, p in shares.items() for side, f in (("low", F.floor), ("high", F.ceil))} | {"_last": F.col("_n") - 1}
    got = values_at(df, group, value, both)
    n = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    part = lambda p: at(p) - F.floor(at(p))
    between = lambda name, p: F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * part(p)
    return got.join(n, group).select(group, *[F.round(between(name, p), 6).alias(name) for name, p in shares.items()])


def latency_by_index(df: DataFrame, group: str, value: str, bins: int = 4096) -> DataFrame:
    """Percentiles as the sorted list's element at int(p n); a null counts as 0 in the mean alone."""
    places = {"median": F.expr("_n div 2"), "p95": F.floor(F.col("_n") * F.lit(0.95)), "p99": F.floor(F.col("_n") * F.lit(0.99))}
    tail = values_at(df, group, value, places, bins)
    head = df.groupBy(group).agg(F.round(F.avg(F.coalesce(value, F.lit(0.0))), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("stdev"), F.min(value).alias("low"), F.max(value).alias("high"))
    return head.join(tail, group, "left")


def latency_linear(df: DataFrame, group: str, value: str) -> DataFrame:
    """Interpolated percentiles."""
    head = df.groupBy(group).agg(F.round(F.avg(value), 6).alias("mean"))
    return head.join(percentiles(df, group, value, {"p5": 0.05, "median": 0.5, "p95": 0.95}), group, "left")


def sweep(runs: DataFrame) -> DataFrame:
    """Nlist, nprobe, ms, recall by setting."""
    g = runs.groupBy("nlist", "nprobe")
    return g.agg(F.count(F.lit(1)).alias("queries"), *[F.round(f, 6).alias(a) for a, f in (("avg_ms", F.avg("ms")), ("median_ms", F.median("ms")), ("std_ms", F.stddev_samp("ms")), ("avg_recall", F.avg("recall")), ("median_recall", F.median("recall")), ("min_recall", F.min("recall")), ("max_recall", F.max("recall")))])


def pivot_first(df: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """The columns are named, so no pass over the data finds them."""
    return df.groupBy(row).pivot(column, columns).agg(F.first(value))


def outer_summary(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """D14."""
    return a.join(b, keys, "full_outer")


def best_setting(runs: DataFrame, least_recall: float, cost: str = "avg_ms", recall: str = "avg_recall") -> DataFrame:
    """The cheapest of those that recall enough."""
    return runs.filter(F.col(recall) >= least_recall).orderBy(cost, "nlist", "nprobe").limit(1)


def trend(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """From the first to the last by `order`."""
    g = df.groupBy(group).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))
    return g.withColumn("change", F.round(F.col("last") - F.col("first"), 6))


def trial_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """E24."""
    return df.groupBy(group).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("std"))


def margin(p: Column, n: Column) -> Column:
    """Half the width of the 95 % interval of a share."""
    return 1.96 * F.sqrt(p * (1 - p) / n)


def level_band(pc1: float) -> str:
    """I48, E25."""
    return "high" if pc1 >= 0.30 else "moderate" if pc1 >= 0.15 else "low"


def robustness_band(keep80: float, keep60: float) -> str:
    """Overlap with 80 and 60 per cent of the dimensions kept."""
    return "robust" if keep80 >= 0.80 and keep60 >= 0.70 else "moderate" if keep80 >= 0.70 and keep60 >= 0.55 else "fragile"


def pca_energy(vectors: DataFrame, column: str = "embedding") -> dict:
    """Shares of variance by principal component, from sums that are dimension by dimension squared.

    Each batch adds its Gram matrix, so the driver gets d x d numbers a partition whatever the rows.
    """
    import pyarrow as pa

    def each(batches):
        total = None
        for b in batches:
            x = np.asarray(b.column(0).to_pylist(), float)
            if len(x):
                part = [len(x), x.sum(0), x.T @ x]
                total = part if total is None else [p + q for p, q in zip(total, part, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total[0]]), pa.array([total[1].tolist()]), pa.array([total[2].ravel().tolist()])], names=["n", "s", "g"])

    rows = vectors.filter(F.col(column).isNotNull()).select(F.col(column).cast("array<double>")).mapInArrow(each, "n long, s array<double>, g array<double>").collect()
    if not rows:
        return {"explained": [], "cumulative": [], "components": {}, "level": "low"}
    n, s = sum(r.n for r in rows), np.sum([r.s for r in rows], 0)
    cov = np.sum([r.g for r in rows], 0).reshape(len(s), len(s)) / n - np.outer(s / n, s / n)
    e = np.maximum(np.linalg.eigvalsh(cov)[::-1], 0)
    e = e / max(e.sum(), 1e-30)
    c = np.cumsum(e)
    return {"explained": e.tolist(), "cumulative": c.tolist(), "components": {p: int(np.searchsorted(c, p - 1e-12) + 1) for p in (0.8, 0.9, 0.95)}, "level": level_band(float(e[0]))}


def kept_dimensions(keep: float, seed: int, dim: int = 64) -> list[int]:
    """A random part of the dimensions."""
    return sorted(np.random.default_rng(seed).choice(dim, max(1, round(keep * dim)), replace=False).tolist())


def masked(vectors: DataFrame, keep: float, seed: int, column: str = "embedding", dim: int = 64) -> DataFrame:
    """A random part of the dimensions, normalised again."""
    from ..functions.vectors import normalize

    return vectors.withColumn(column, normalize(F.array(*[F.col(column)[i] for i in kept_dimensions(keep, seed, dim)])))


def ablations(vectors: DataFrame, keeps: Sequence[float], trials: int = 6, k: int = 10, dim: int = 64, every: int = 20) -> list[dict]:
    """For each share of dimensions how much of the k nearest stays when the others go.

    The vectors whose id divides by `every` are asked for, among all vectors. All dimensions and each
    trial's are searched in one pass. Of many vectors each task counts what its own keep; of up to
    FEW_ASKED what is found is stored. Only counts come to the driver.
    """
    parts = [list(range(dim)), *(kept_dimensions(keep, t, dim) for keep in keeps for t in range(trials))]
    v = vectors.filter(F.size("embedding") == dim).select("chunk_id", "embedding")
    asked = v.filter(F.col("chunk_id") % every == 0)
    kept = (_kept_of_many if asked.limit(FEW_ASKED + 1).count() > FEW_ASKED else _kept_of_few)(v, every, k, parts)
    n = max(1, kept.get(0, 0))
    shares = [kept.get(i, 0) / n for i in range(1, len(parts))]
    by_keep = [shares[i * trials : (i + 1) * trials] for i in range(len(keeps))]
    return [{"keep": keep, "mean": float(np.mean(s)), "std": float(np.std(s))} for keep, s in zip(keeps, by_keep, strict=True)]


#: Vectors that are asked for by a broadcast.
FEW_ASKED = 500


def _kept_of_few(v: DataFrame, every: int, k: int, parts: list[list[int]]) -> dict[int, int]:
    """How many of the k nearest others by part 0 are also among those by each part."""
    from .retrieval import self_neighbours

    place = f"{own_folder(v.sparkSession, 'ablation')}/found"
    self_neighbours(v, k, every=every, parts=parts).select("part", "query_id", "chunk_id").write.parquet(place)
    found = v.sparkSession.read.schema("part int, query_id long, chunk_id long").parquet(place)
    whole = found.filter("part = 0").drop("part")
    return {r.part: r.n for r in found.join(whole, ["query_id", "chunk_id"], "left_semi").groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}


def _kept_of_many(v: DataFrame, every: int, k: int, parts: list[list[int]]) -> dict[int, int]:
    """_kept_of_few of any number: counted where a block of queries is searched, so nothing that is found is shuffled or stored."""
    from .retrieval import blocks_of_parts

    queries = v.filter(F.col("chunk_id") % every == 0).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    counts = blocks_of_parts(v, queries, k + 1, parts, lambda found: kept_by_part(found, k), "part int, n long", len(parts[0]))
    return {r.part: r.n for r in counts.groupBy("part").agg(F.sum("n").alias("n")).collect()}


def kept_by_part(found: list, k: int):
    """part, n: of some queries' k + 1 best by each part (query_id, chunk_id, similarity), how many of the k others by part 0 are also among those by the part."""
    import pyarrow as pa

    from .retrieval import best_places

    pairs = []
    for b in found:
        q, c, s = (x.to_numpy() for x in b.columns)
        first = best_places(q, c, s, k + 1)
        q, c, s = (x[first[q[first] != c[first]]] for x in (q, c, s))
        others = best_places(q, c, s, k)
        pairs.append((q[others], c[others]))
    q, c = (np.unique(np.concatenate(x), return_inverse=True) for x in zip(*pairs, strict=True))
    keys = np.split(q[1] * len(c[0]) + c[1], np.cumsum([len(p[0]) for p in pairs])[:-1])
    n = [int(np.isin(x, keys[0]).sum()) for x in keys]
    return pa.RecordBatch.from_arrays([pa.array(range(len(n)), pa.int32()), pa.array(n, pa.int64())], names=["part", "n"])


def ablation(vectors: DataFrame, keep: float, trials: int = 6, k: int = 10, dim: int = 64, every: int = 20) -> dict:
    """ablations() of one share."""
    return ablations(vectors, [keep], trials, k, dim, every)[0]


def compare_runs(runs: dict[str, DataFrame], base: str, key: str = "query_id", item: str = "chunk_id", rank: str = "rank") -> DataFrame:
    """Overlap, recall and rank correlation of each run with the base, query by query (joined by query, not by place)."""
    out = None
    for name, run in runs.items():
        if name == base:
            continue
        o = overlap(runs[base], run, key, item).join(rank_correlation(runs[base], run, key, item, rank), key)
        o = o.select(F.lit(name).alias("strategy"), key, F.round(jaccard(F.col("n_a"), F.col("n_b"), F.col("n_both")), 6).alias("jaccard"), F.round(recall(F.col("n_a"), F.col("n_both")), 6).alias("recall"), "rank_correlation")
        out = o if out is None else out.unionByName(o)
    return out


def composition(phrases: DataFrame, embedder, a: str = "a", b: str = "b", both: str = "both") -> DataFrame:
    """Of each row (two phrases and their conjunction): how near the normalised sum of the two lies to the conjunction, and how near each does."""
    from ..functions.vectors import cosine
    from ..plug import embed

    v = phrases
    for c in (a, b, both):
        v = embed(v, embedder, c, f"_{c}").withColumn(f"_{c}", F.col(f"_{c}").cast("array<double>"))
    mixed = F.zip_with(F.col(f"_{a}"), F.col(f"_{b}"), lambda x, y: x + y)
    near = lambda x, y: F.round(cosine(x, y), 6)
    whole = F.col(f"_{both}")
    return v.select(*phrases.columns, near(mixed, whole).alias("sum_to_both"), near(F.col(f"_{a}"), whole).alias("first_to_both"), near(F.col(f"_{b}"), whole).alias("second_to_both"))
