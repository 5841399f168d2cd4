"""Exact top-k by inner product: a Voronoi join whose per-group bounds say which rows a group of queries needs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_out, mix

#: Largest and smallest score: scores beyond a long are held at its ends.
LONG = (-(1 << 63), (1 << 63) - 1)


@dataclass
class Settings:
    """k; factor: components become floor(factor * x); pivots: cells at most, one for `per_pivot` rows, fitted on
    `sample` rows at most; rings: parts of a cell by distance to its pivot; queries: of a group of cells and of one
    task, at most; least_queries: groups are not made smaller than this; chunk: rows of a task beside them, about."""

    k: int = 20
    factor: float = 64.0
    pivots: int = 1024
    per_pivot: int = 256
    sample: int = 16384
    rings: int = 16
    queries: int = 2048
    least_queries: int = 512
    groups: int = 24
    chunk: int = 16384
    strip: int = 128
    seed: int = 11


def whole(vector: str = "embedding") -> Column:
    """Not null, and no component null, NaN or infinite; empty and zero vectors are whole."""
    bad = F.exists(F.col(vector), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False))


def packed(q: np.ndarray) -> bytes:
    """Integer components as bytes: an even number (16 bits each) where they fit, else an odd one (a mark, then doubles)."""
    return q.astype("<i2").tobytes() if not len(q) or np.abs(q).max() < 32768 else b"\1" + q.astype("<f8").tobytes()


def unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<i2").astype(np.float64) if len(b) % 2 == 0 else np.frombuffer(b[1:], "<f8")


def matrices(rows: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) for each length that the vectors have."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    out = []
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        if n % 2 == 0:
            out.append((at, np.frombuffer(b"".join(rows[i] for i in at), "<i2").reshape(len(at), -1).astype(np.float64)))
        else:
            out.append((at, np.stack([unpacked(rows[i]) for i in at])))
    return out


def quantise(column: pa.Array, factor: float) -> list[bytes]:
    """floor(factor * x) of each component, as bytes; what overflows a double is held at its largest."""
    most, out = np.finfo(np.float64).max, []
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        flat = np.clip(np.floor(factor * flat), -most, most)
    if len(sizes) and (sizes == sizes[0]).all() and sizes[0] and np.abs(flat).max(initial=0) < 32768:
        return [x.tobytes() for x in flat.reshape(len(sizes), -1).astype("<i2")]
    ends = np.cumsum(sizes)
    for e, n in zip(ends, sizes, strict=True):
        out.append(packed(flat[e - n : e]))
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """q @ x.T of integers, exact; a shorter vector counts as ended by zeros. Scores beyond a long are held at its ends."""
    n = min(q.shape[1], x.shape[1])
    q, x = q[:, :n], x[:, :n]
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(n, 1)
    if most < 1 << 24:
        return (q.astype(np.float32) @ x.astype(np.float32).T).astype(np.int64)
    if most < 1 << 53:
        return (q @ x.T).astype(np.int64)
    whole_numbers = lambda m: np.asarray([[int(v) for v in row] for row in m.tolist()], object).reshape(m.shape)
    exact = whole_numbers(q) @ whole_numbers(x).T if n else np.zeros((len(q), len(x)), object)
    return np.asarray([[min(max(int(v), LONG[0]), LONG[1]) for v in row] for row in exact.tolist()], np.int64).reshape(exact.shape)


def squares(m: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.einsum("ij,ij->i", m, m)


def choose_pivots(rows: list[bytes], most: int, seed: int) -> np.ndarray:
    """A few rounds of k-means over a sample's distinct vectors; integer centres, so that any task finds the same cell."""
    rows = sorted(set(rows))
    wide = max((len(unpacked(r)) for r in rows), default=0)
    x = np.zeros((len(rows), wide))
    for at, m in matrices(rows):
        x[at, : m.shape[1]] = m
    x = x[(np.abs(x) < 2**40).all(axis=1)]  # beyond it squares lose what the bounds need; such rows still get a cell
    if not len(x):
        return np.zeros((1, wide))
    rng = np.random.default_rng(seed)
    pivots = x[np.sort(rng.permutation(len(x))[:most])]
    for _ in range(4):
        cell, _ = nearest_pivot(x, pivots)
        n = np.bincount(cell, minlength=len(pivots))
        total = np.zeros_like(pivots)
        np.add.at(total, cell, x)
        pivots = np.where(n[:, None] > 0, np.rint(total / np.maximum(n, 1)[:, None]), pivots)
    return np.unique(pivots, axis=0)


def nearest_pivot(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each row and its distance to the pivot."""
    cell, far = np.zeros(len(x), np.int64), np.zeros(len(x))
    n = min(x.shape[1], pivots.shape[1])
    own, theirs = squares(x), squares(pivots)
    with np.errstate(over="ignore", invalid="ignore"):
        for s in range(0, len(x), 4096):
            d = theirs - 2 * (x[s : s + 4096, :n] @ pivots[:, :n].T)
            cell[s : s + 4096] = np.nan_to_num(d, nan=np.inf).argmin(axis=1)
        p = pivots[cell]
        cross = np.einsum("ij,ij->i", x[:, :n], p[:, :n])
        far = np.sqrt(np.maximum(own + theirs[cell] - 2 * cross, 0))
    return cell, np.nan_to_num(far, nan=np.inf)


@dataclass
class Plan:
    """Which groups of query cells need which rings of rows, and into how many parts each side of a group is cut."""

    of_cell: np.ndarray  # group of a query cell, -1: no queries
    needs: np.ndarray  # [cell * rings + ring, group]
    blocks: np.ndarray  # of a group's queries
    chunks: np.ndarray  # of the rows that a group needs


def bounds(pivots: np.ndarray, q: dict, r: dict, enough: int, cells: np.ndarray) -> np.ndarray:
    """needs[query cell, ring]: whether a row of the ring may be among the best `enough` of any query of the cell.

    Queries lie within `far` of their pivot, a ring's rows between `least` and `far` of theirs, so the
    distance of a query to a row lies between |pi - pj| - far_i - far_j (or least_j - |pi - pj| - far_i)
    and far_i + |pi - pj| + far_j; with 2 q.x = |q|^2 + |x|^2 - |q - x|^2 and with q.x = q.pj + q.(x - pj)
    these bound the score from both sides. The best `enough` rows reach at least the bound from below
    that rings with so many rows reach; a ring whose bound from above is less holds none of them.
    """
    out = np.zeros((len(cells), len(r["cell"])), bool)
    p2 = squares(pivots)
    for at, i in enumerate(cells):
        with np.errstate(over="ignore", invalid="ignore"):
            dot = pivots[r["cell"]] @ pivots[i]
            apart = np.sqrt(np.maximum(p2[i] + p2[r["cell"]] - 2 * dot, 0))
            most = np.sqrt(q["most"][i]) * np.sqrt(r["most"])
            wide = q["far"][i] * np.sqrt(p2[r["cell"]]) + np.sqrt(q["most"][i]) * r["far"]
            gap = np.maximum(np.maximum(apart - q["far"][i] - r["far"], r["least"] - apart - q["far"][i]), 0)
            high = np.minimum(np.minimum((q["most"][i] + r["most"] - gap**2) / 2, most), dot + wide)
            low = np.maximum(np.maximum((q["small"][i] + r["small"] - (q["far"][i] + apart + r["far"]) ** 2) / 2, -most), dot - wide)
            slack = 1e-9 * (q["most"][i] + r["most"].max(initial=0) + p2[i] + p2.max() + 1)
            order = np.argsort(-np.nan_to_num(low, nan=-np.inf), kind="stable")
            reached = np.searchsorted(np.cumsum(r["n"][order]), enough)
            least = np.nan_to_num(low, nan=-np.inf)[order[reached]] if reached < len(order) else -np.inf
            out[at] = ~(high < least - slack)
    return out


def plan(pivots: np.ndarray, summary: list, settings: Settings) -> Plan:
    """From the summaries of all rings (at most pivots x rings) and query cells."""
    kinds = {"cell": np.int64, "ring": np.int64, "n": np.int64, "least": float, "far": float, "small": float, "most": float}
    rows, asked = [s for s in summary if not s["query"]], [s for s in summary if s["query"]]
    r = {k: np.asarray([s[k] for s in rows], t) for k, t in kinds.items()}
    q = {k: np.full(len(pivots), -1.0) for k in ("far", "small", "most")} | {"n": np.zeros(len(pivots), np.int64)}
    for s in asked:
        c = s["cell"]
        q["n"][c] += s["n"]
        q["far"][c], q["most"][c] = max(q["far"][c], s["far"]), max(q["most"][c], s["most"])
        q["small"][c] = s["small"] if q["small"][c] < 0 else min(q["small"][c], s["small"])
    cells = np.flatnonzero(q["n"])
    need = bounds(pivots, q, r, settings.k + 1, cells)
    size = int(min(max(math.ceil(q["n"].sum() / settings.groups), settings.least_queries), settings.queries))
    # Cells that lie together go together, as long as their queries fit a task.
    left, groups = list(range(len(cells))), []
    while left:
        members, held = [left.pop(0)], 0
        held = q["n"][cells[members[0]]]
        if left and held < size:
            away = np.linalg.norm(pivots[cells[left]] - pivots[cells[members[0]]], axis=1)
            for j in [left[x] for x in np.argsort(away, kind="stable")]:
                if held + q["n"][cells[j]] > size:
                    break
                members.append(j)
                held += q["n"][cells[j]]
            taken = set(members)
            left = [j for j in left if j not in taken]
        groups.append(members)
    of_cell = np.full(len(pivots), -1)
    needs = np.zeros((len(pivots) * settings.rings, len(groups)), bool)
    blocks, chunks = np.ones(len(groups), np.int64), np.ones(len(groups), np.int64)
    for g, members in enumerate(groups):
        of_cell[cells[members]] = g
        any_of = need[members].any(axis=0)
        needs[r["cell"][any_of] * settings.rings + r["ring"][any_of], g] = True
        blocks[g] = math.ceil(q["n"][cells[members]].sum() / settings.queries)
        chunks[g] = max(1, math.ceil(r["n"][any_of].sum() / settings.chunk))
    return Plan(of_cell, needs, blocks, chunks)


def best(query: np.ndarray, row: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k highest scores, ties to the smaller row."""
    order = np.lexsort((row, ~score, query))  # ~score falls as score grows, without overflow
    first = np.flatnonzero(np.diff(query[order], prepend=query[order[0]] - 1)) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[rank < k]


def solve(q_ids: np.ndarray, q_rows: list[bytes], ids: np.ndarray, rows: list[bytes], k: int, strip: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vec id, score) of each query's k best among the rows, itself not counted."""
    parts = [(np.zeros(0, np.int64),) * 3]
    by_length = matrices(rows)
    for q_at, q in matrices(q_rows):
        for s in range(0, len(q_at), strip):
            at = q_at[s : s + strip]
            found = [(np.zeros(0, np.int64),) * 3]
            for x_at, x in by_length:
                scores = products(q[s : s + strip], x)
                own = q_ids[at][:, None] == ids[x_at][None]
                scores[own] = LONG[0]
                # k + 1: the query's own row, held at the least score, is dropped below
                kth = np.partition(scores, -(k + 1), axis=1)[:, -(k + 1)] if len(x_at) > k + 1 else np.full(len(at), LONG[0])
                i, j = np.nonzero((scores >= kth[:, None]) & ~own)
                found.append((q_ids[at][i], ids[x_at][j], scores[i, j]))
            q_, v, sc = (np.concatenate(c) for c in zip(*found, strict=True))
            keep = best(q_, v, sc, k)
            parts.append((q_[keep], v[keep], sc[keep]))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def first_copies(ids: np.ndarray, rows: list[bytes], most: int) -> np.ndarray:
    """Places of the rows without those that have `most` equals of smaller ids here: none of them is among any query's best."""
    kinds: dict[bytes, int] = {}
    code = np.fromiter((kinds.setdefault(r, len(kinds)) for r in rows), np.int64, len(rows))
    if len(kinds) == len(rows):
        return np.arange(len(rows))
    order = np.lexsort((ids, code))
    first = np.flatnonzero(np.diff(code[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return np.sort(order[rank < most])


def search(spark: SparkSession, vectors: DataFrame, scratch: Scratch, every: int = 20, settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of highest integer inner product of each whose vec_id divides by `every`.

    1. Vectors are made integers once and laid into the cell of their nearest pivot, in rings by the
    distance to it. 2. A row per ring and per query cell (numbers of rows, ranges of distances and
    norms; at most 2 x pivots x rings of them) goes to the driver, which bounds the scores of each
    pair and groups the query cells. 3. Rows go to the groups whose bounds do not rule them out and
    nowhere else; a group's queries and rows are cut into blocks and chunks by hashes of their ids,
    so a task holds a block and a chunk, however hot a cell. 4. A task's k best of each query are
    merged by query. Of equal vectors only those of the k + 1 smallest ids in a batch go on.

    Vectors that are null or hold null or non-finite components take no part, nor do null vec_ids.
    Zero and empty vectors do (score 0); a shorter vector counts as ended by zeros. Repeated rows of
    a vec_id: the smallest vector holds. Ties go to the smaller vec_id. Scores beyond a long are held
    at its ends. Fewer candidates than k: all. Empty table: no rows. Other columns are not read.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & whole())
    integer_schema = pa.schema([("vec_id", pa.int64()), ("vector", pa.binary())])

    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield arrow_out(integer_schema, {"vec_id": b.column("vec_id"), "vector": quantise(b.column("embedding"), settings.factor)})

    v = v.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).mapInArrow(integers, "vec_id long, vector binary")
    v = scratch.save(v, "integers")
    n = v.count()
    few = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(settings.sample).select("vector").toArrow().column(0).to_pylist()
    pivots = choose_pivots(few, min(settings.pivots, max(8, n // settings.per_pivot)), settings.seed)
    step = ring_width(few, pivots, settings.rings)
    shared = spark.sparkContext.broadcast((pivots, step))
    cell_schema = pa.schema([("vec_id", pa.int64()), ("vector", pa.binary()), ("query", pa.bool_()), ("cell", pa.int32()), ("ring", pa.int32()), ("far", pa.float64()), ("square", pa.float64())])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, step = shared.value
        for b in batches:
            ids, rows = b.column("vec_id").to_numpy(), b.column("vector").to_pylist()
            cell, far, square = np.zeros(len(ids), np.int32), np.zeros(len(ids)), np.zeros(len(ids))
            for at, x in matrices(rows):
                cell[at], far[at] = nearest_pivot(x, pivots)
                square[at] = squares(x)
            ring = np.minimum(far / step, settings.rings - 1).astype(np.int32)
            out = {"vec_id": ids, "vector": rows, "cell": cell, "ring": ring, "far": far, "square": square}
            for asked, at in ((True, np.flatnonzero(ids % every == 0)), (False, first_copies(ids, rows, settings.k + 1))):
                if len(at):
                    yield arrow_out(cell_schema, {k: [x[i] for i in at] if isinstance(x, list) else x[at] for k, x in out.items()} | {"query": [asked] * len(at)})

    v = scratch.save(v.mapInArrow(cells, "vec_id long, vector binary, query boolean, cell int, ring int, far double, square double"), "cells")
    # Distances are computed: what the bounds rest on is widened by more than their rounding.
    wide = F.lit(1e-9) * (F.max("far") + F.sqrt(F.max("square")) + 1)
    summary = v.groupBy("query", "cell", "ring").agg(F.count(F.lit(1)).alias("n"), (F.min("far") - wide).alias("least"), (F.max("far") + wide).alias("far"), F.min("square").alias("small"), F.max("square").alias("most")).collect()
    empty = "query_id long, rank int, vec_id long, score long"
    if not any(s["query"] for s in summary):
        return spark.createDataFrame([], empty)
    planned = spark.sparkContext.broadcast(plan(pivots, summary, settings))
    dealt_schema = pa.schema([("g", pa.int32()), ("block", pa.int32()), ("chunk", pa.int32()), ("query", pa.bool_()), ("vec_id", pa.int64()), ("vector", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = planned.value
        for b in batches:
            ids, rows, asked = b.column("vec_id").to_numpy(), b.column("vector"), b.column("query").to_numpy(zero_copy_only=False)
            cell, ring = b.column("cell").to_numpy(), b.column("ring").to_numpy()
            salt = mix(ids.astype(np.uint64)) >> np.uint64(2)
            for g in range(len(p.blocks)):
                block, chunk = salt % np.uint64(p.blocks[g]), salt % np.uint64(p.chunks[g])
                mine = np.flatnonzero(asked & (p.of_cell[cell] == g))
                needed = np.flatnonzero(~asked & p.needs[cell * settings.rings + ring, g])
                for query, at, own, copies in ((True, mine, block, int(p.chunks[g])), (False, needed, chunk, int(p.blocks[g]))):
                    for other in range(copies) if len(at) else ():
                        other = np.full(len(at), other)
                        pair = (own[at], other) if query else (other, own[at])
                        yield arrow_out(dealt_schema, {"g": np.full(len(at), g), "block": pair[0].astype(np.int32), "chunk": pair[1].astype(np.int32), "query": np.full(len(at), query), "vec_id": ids[at], "vector": rows.take(pa.array(at))})

    def join(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        asked, ids, rows = (group.column(c) for c in ("query", "vec_id", "vector"))
        asked, ids, rows = asked.to_numpy(), ids.to_numpy(), rows.to_pylist()
        left, right = np.flatnonzero(asked), np.flatnonzero(~asked)
        q, x, s = solve(ids[left], [rows[i] for i in left], ids[right], [rows[i] for i in right], settings.k, settings.strip) if len(left) and len(right) else (np.zeros(0, np.int64),) * 3
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(x, pa.int64()), "score": pa.array(s, pa.int64())})

    dealt = v.mapInArrow(deal, "g int, block int, chunk int, query boolean, vec_id long, vector binary")
    found = dealt.groupBy("g", "block", "chunk").applyInArrow(join, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place.cast("int")).filter(F.col("rank") <= settings.k).select("query_id", "rank", "vec_id", "score")


def ring_width(sample: list[bytes], pivots: np.ndarray, rings: int) -> float:
    """So that the sample's distances to their pivots fill the rings (the last is open)."""
    far = np.concatenate([nearest_pivot(x, pivots)[1] for _, x in matrices(sample)] or [np.zeros(0)])
    far = far[np.isfinite(far)]
    return max(float(np.quantile(far, 0.99)) / (rings - 1), 1e-9) if len(far) else 1.0


#: search over the embeddings table in DuckDB's SQL.
VORONOI_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
placed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 20
"""
