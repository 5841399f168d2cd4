"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue over all of them, exact reranking."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, release


@dataclass
class Settings:
    """trees; leaf: rows a leaf, about, which gives the depth; sample: rows that the splits of a tree are fitted
    on at most, eight a leaf; most: a leaf with more rows gets a tree of its own, fitted on its rows; recall, probes: leaves are read until
    so many queries' true neighbours, found by brute force, are so far covered; rows: leaves are read until
    they hold so many rows, summed over the trees, whatever the recall (None: as recall asks; all rows times
    the trees: everything, an exact search); block, queries: of a group of leaves, rows and queries a task."""

    trees: int = 4
    leaf: int = 128
    sample: int = 16384
    most: int = 1024
    recall: float = 0.96
    probes: int = 128
    rows: int | None = None
    block: int = 8192
    queries: int = 2048
    seed: int = 7


@dataclass
class Forest:
    """Complete trees: node i has children 2i+1 and 2i+2; directions[tree, node], cuts[tree, node]."""

    directions: np.ndarray
    cuts: np.ndarray
    depth: int

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        out = np.zeros((len(x), len(self.cuts)), np.int32)
        for t in range(len(self.cuts)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", x, self.directions[t, node]) > self.cuts[t, node]
                node = 2 * node + 1 + side
            out[:, t] = node - ((1 << self.depth) - 1)
        return out

    def leaves_from(self, q: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """(cost, tree, leaf), all of them, in the queue's order.

        One queue holds nodes of all trees by the largest margin crossed on their way: going along
        with the query costs nothing, against it the distance to the cut.
        """
        margins = self.directions @ q - self.cuts
        inner = (1 << self.depth) - 1
        queue = [(0.0, t, 0) for t in range(len(self.cuts))]
        while queue:
            cost, t, node = heapq.heappop(queue)
            while node < inner:
                m = margins[t, node]
                heapq.heappush(queue, (max(cost, abs(m)), t, 2 * node + (1 if m > 0 else 2)))
                node = 2 * node + (2 if m > 0 else 1)
            yield cost, t, node - inner

    def search(self, q: np.ndarray, rows: np.ndarray, enough: int) -> list[tuple[float, int, int]]:
        """The first (cost, tree, leaf) whose rows reach `enough`, without empty ones."""
        got, total = [], 0
        for cost, t, leaf in self.leaves_from(q):
            if total >= enough:
                break
            if rows[t, leaf]:
                got.append((cost, t, leaf))
                total += int(rows[t, leaf])
        return got

    def needed(self, q: np.ndarray, rows: np.ndarray, wanted: np.ndarray) -> list[int]:
        """How many rows are read before each wanted row's (a line: its leaf in each tree) first leaf is; ends with the last."""
        need: list[int | None] = [None] * len(wanted)
        total, left = 0, len(wanted)
        for _, t, leaf in self.leaves_from(q):
            if not left:
                break
            if rows[t, leaf]:
                total += int(rows[t, leaf])
                for i in np.flatnonzero(wanted[:, t] == leaf):
                    if need[i] is None:
                        need[i], left = total, left - 1
        return [n for n in need if n is not None]


def grow(x: np.ndarray, depth: int, settings: Settings) -> Forest:
    """Each node cuts its rows of the sample at the median along the line between two of them (or, if they are one point, a random line)."""
    rng, d, inner = np.random.default_rng(settings.seed), x.shape[1], (1 << depth) - 1
    directions, cuts = np.zeros((settings.trees, inner, d)), np.zeros((settings.trees, inner))
    for t in range(settings.trees):
        members = {0: np.arange(len(x))}
        for node in range(inner):
            rows = members.pop(node, np.zeros(0, int))
            line = rng.standard_normal(d)
            if len(rows) > 1:
                a, b = rng.choice(rows, 2, replace=False)
                if np.linalg.norm(x[a] - x[b]) > 1e-9:
                    line = x[a] - x[b]
            directions[t, node] = line / np.linalg.norm(line)
            along = x[rows] @ directions[t, node]
            cuts[t, node] = np.median(along) if len(rows) else 0.0
            if 2 * node + 1 < inner:
                members[2 * node + 1], members[2 * node + 2] = rows[along <= cuts[t, node]], rows[along > cuts[t, node]]
    return Forest(directions, cuts, depth)


def usable(vector: str = "embedding") -> Column:
    """Not null, not empty, all components finite, not zero."""
    bad = F.exists(F.col(vector), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(F.col(vector), lambda v: v != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows by their norms (scaled first, so that no square over- or underflows)."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def nearest(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, row's place, cosine) arrays that hold each query's k best other rows (and what is within rounding of the k-th).

    A product finds them; these are computed one by one, so that equal vectors score alike.
    """
    scores = q @ x.T
    scores[q_ids[:, None] == ids[None]] = -np.inf
    kth = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(q), -np.inf)
    i, j = np.nonzero((scores >= kth[:, None] - 1e-9) & np.isfinite(scores))
    exact = np.empty(len(i))
    for s in range(0, len(i), 65536):
        exact[s : s + 65536] = np.einsum("ij,ij->i", x[j[s : s + 65536]], q[i[s : s + 65536]])
    return i, j, exact


def best(query: np.ndarray, row: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best rows, ties to the smaller row."""
    order = np.lexsort((row, -score, query))
    first = np.flatnonzero(np.diff(query[order], prepend=query[order[0]] - 1)) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[rank < k]


def units(column: pa.Array) -> np.ndarray:
    """Vectors that travel as their bytes."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


FOUND = "query_id long, vec_id long, score double"


def found(query: np.ndarray, row: np.ndarray, score: np.ndarray) -> pa.Table:
    return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(row, pa.int64()), "score": pa.array(score, pa.float64())})


def true_neighbours(placed: DataFrame, k: int, every: int, settings: Settings) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """query_id, vec_id, leaves of the k true neighbours of settings.probes queries (the smallest hashes); the probes' ids and vectors.

    One pass over all rows, each task keeping k a probe.
    """
    probes = placed.filter(F.col("vec_id") % every == 0).orderBy(F.xxhash64("vec_id"), "vec_id").limit(settings.probes).select("vec_id", "unit").toArrow()
    q_ids, q = probes.column("vec_id").to_numpy(), units(probes.column("unit")) if probes.num_rows else np.zeros((0, 1))
    shared = placed.sparkSession.sparkContext.broadcast((q_ids, q))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, settings.trees), np.int32)]
        for b in batches if len(ids) else ():
            own = b.column("vec_id").to_numpy()
            i, j, score = nearest(ids, vectors, own, units(b.column("unit")), k)
            leaves = b.column("leaves").flatten().to_numpy().reshape(len(own), -1)
            held = [np.concatenate(x) for x in zip(held, (ids[i], own[j], score, leaves[j]), strict=True)]
            keep = best(*held[:3], k)
            held = [x[keep] for x in held]
        t = found(*held[:3]).append_column("leaves", pa.ListArray.from_arrays(np.arange(0, held[3].size + 1, settings.trees, dtype=np.int32), held[3].ravel()))
        yield from t.to_batches()

    near = placed.select("vec_id", "unit", "leaves").mapInArrow(compare, f"{FOUND}, leaves array<int>")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return near.select("query_id", "vec_id", "leaves"), q_ids, q


def budget(needs: list[int], wanted: int, recall: float) -> int | None:
    """The rows that bring the stated share of the wanted neighbours; None if too few of them were found."""
    at = min(wanted - 1, int(np.ceil(recall * wanted)))
    return sorted(needs)[at] if at < len(needs) else None


def enough_rows(placed: DataFrame, forest: Forest, rows: np.ndarray, k: int, every: int, settings: Settings) -> int:
    """The budget: so many rows a query, over all trees, that the stated share of true neighbours is among them, as the forest orders its leaves."""
    near, q_ids, q = true_neighbours(placed, k, every, settings)
    wanted: dict[int, list] = {}
    for r in near.select("query_id", "leaves").collect():  # probes x k at most
        wanted.setdefault(r.query_id, []).append(r.leaves)
    needs = [n for i, v in zip(q_ids, q, strict=True) if int(i) in wanted for n in forest.needed(v, rows, np.asarray(wanted[int(i)]))]
    return (budget(needs, len(needs), settings.recall) or 0) if needs else 0


#: A leaf of a tree inside leaf L is (L + 1) * FAN + its place there, so no two leaves of a tree share a number.
FAN = 4096
#: Trees within leaves within leaves, as far as 64 bits number them; a leaf that is still large then is cut into blocks as any group is.
LEVELS = 4
ENTRY = "id long, tree int, leaf long, cost double, rows long"


def beside(rows: DataFrame, cells: DataFrame, per: int, function, schema: str) -> DataFrame:
    """`function` on the rows of a leaf, about `per` of them a task, beside that leaf's tree."""
    parts = rows.groupBy("tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / per).cast("int").alias("parts"))
    left = rows.join(parts, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    right = cells.join(parts, ["tree", "leaf"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return left.groupBy("tree", "leaf", "part").cogroup(right.groupBy("tree", "leaf", "part")).applyInArrow(function, schema)


def tree_of(cell: pa.Table) -> Forest:
    r = cell.select(["depth", "directions", "cuts"]).slice(0, 1).to_pylist()[0]
    cuts = np.frombuffer(r["cuts"])
    return Forest(np.frombuffer(r["directions"]).reshape(1, len(cuts), -1), cuts.reshape(1, -1), r["depth"])


def deepen(spread: DataFrame, scratch: Scratch, settings: Settings) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Leaves of more than settings.most rows get trees of their own until none is left: rows with their last leaf, leaves' counts, the trees by level.

    A tree is fitted on about settings.sample rows of its leaf, chosen by their ids' hashes, and
    placed on all of them, which are dealt to tasks whatever the leaf's size. Counts and trees stay tables.
    """
    levels, one = [], replace(settings, trees=1)
    counts = scratch.save(spread.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("rows")), "counts-0")

    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        n, t, leaf = (group.column(c)[0].as_py() for c in ("rows", "tree", "leaf"))
        x = units(group.column("unit"))
        depth = max(1, min(int(np.ceil(np.log2(n / settings.leaf))), int(np.log2(max(2, len(x) / 8)))))
        f = grow(x, depth, replace(one, seed=(settings.seed, t, leaf)))
        return pa.table({"tree": pa.array([t], pa.int32()), "leaf": pa.array([leaf], pa.int64()), "depth": pa.array([depth], pa.int32()), "directions": [f.directions.tobytes()], "cuts": [f.cuts.tobytes()]})

    def place(group: pa.Table, cell: pa.Table) -> pa.Table:
        if not group.num_rows or not cell.num_rows:
            return group.select(["id", "unit", "tree", "leaf"])
        sub = tree_of(cell).leaves(units(group.column("unit")))[:, 0]
        leaf = (group.column("leaf").to_numpy() + 1) * FAN + sub
        return group.select(["id", "unit", "tree"]).append_column("leaf", pa.array(leaf, pa.int64()))

    for level in range(1, LEVELS + 1):
        large = counts.filter(F.col("rows") > settings.most)
        if large.isEmpty():
            break
        share = F.lit(float(settings.sample)) / F.col("rows")
        chosen = spread.join(large, ["tree", "leaf"]).filter(F.pmod(F.xxhash64(F.lit(level), "id"), F.lit(1 << 30)) < share * (1 << 30))
        cells = scratch.save(chosen.groupBy("tree", "leaf").applyInArrow(fit, "tree int, leaf long, depth int, directions binary, cuts binary"), f"trees-{level}")
        split = spread.join(large.select("tree", "leaf"), ["tree", "leaf"], "left_semi").select("id", "unit", "tree", "leaf")
        small = spread.join(large.select("tree", "leaf"), ["tree", "leaf"], "left_anti").select("id", "unit", "tree", "leaf")
        spread = scratch.save(small.unionByName(beside(split, cells, 8 * settings.block, place, "id long, unit binary, tree int, leaf long")), f"spread-{level}")
        if level > 1:
            scratch.drop(f"spread-{level - 1}")
        counts = scratch.save(spread.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("rows")), f"counts-{level}")
        within = counts.filter(F.col("leaf") >= FAN).select("tree", F.expr(f"leaf div {FAN} - 1").alias("leaf"), F.struct(F.expr(f"cast(leaf % {FAN} as int)").alias("place"), "rows").alias("s"))
        sizes = within.groupBy("tree", "leaf").agg(F.collect_list("s").alias("sizes"))  # a tree's leaves: 2,048 with the default sample
        levels.append(scratch.save(cells.join(sizes, ["tree", "leaf"]), f"cells-{level}"))
    return spread, counts, levels


def reached(queries: DataFrame, shared, counted, levels: list[DataFrame], enough: int, settings: Settings) -> DataFrame:
    """id, tree, leaf, cost, rows, before: each query's leaves in the queue's order until they hold `enough` rows; `before` of them are read earlier.

    A leaf that was split counts half a leaf's rows on the way down: the one that the query falls
    into costs nothing more, so the queue's next leaves all lie in those entered.
    """
    split = settings.leaf // 2 or 1

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = counted.value
        credit = np.where(rows > settings.most, split, rows)
        for b in batches:
            for i, u in zip(b.column("id").to_pylist(), b.column("unit").to_pylist(), strict=True):
                cost, t, leaf = zip(*shared.value.search(np.frombuffer(u), credit, enough), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(t), pa.int64()), pa.array(t, pa.int32()), pa.array(leaf, pa.int64()), pa.array(cost, pa.float64()), pa.array(rows[list(t), list(leaf)], pa.int64())], names=["id", "tree", "leaf", "cost", "rows"])

    def walk(asks: pa.Table, cell: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in ("id", "leaf", "cost", "rows")}
        if asks.num_rows and cell.num_rows:
            tree, sizes = tree_of(cell), np.zeros(FAN, np.int64)
            for s in cell.column("sizes")[0].as_py():
                sizes[s["place"]] = s["rows"]
            credit = np.where(sizes > settings.most, split, sizes)[None]
            for i, u, leaf, cost in zip(*(asks.column(c).to_pylist() for c in ("id", "unit", "leaf", "cost")), strict=True):
                for more, _, place in tree.search(np.frombuffer(u), credit, enough):
                    for n, value in zip(out, (i, (leaf + 1) * FAN + place, max(cost, more), sizes[place]), strict=True):
                        out[n].append(value)
        t = cell.column("tree")[0].as_py() if cell.num_rows else 0
        return pa.table({"id": pa.array(out["id"], pa.int64()), "tree": pa.array([t] * len(out["id"]), pa.int32()), "leaf": pa.array(out["leaf"], pa.int64()), "cost": pa.array(out["cost"], pa.float64()), "rows": pa.array(out["rows"], pa.int64())})

    entries = queries.select("id", "unit").mapInArrow(enter, ENTRY)
    for cells in levels:
        down = entries.filter(F.col("rows") > settings.most).join(queries.select("id", "unit"), "id")
        entries = entries.filter(F.col("rows") <= settings.most).unionByName(beside(down, cells, settings.queries, walk, ENTRY))
    order = Window.partitionBy("id").orderBy("cost", "tree", "leaf").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return entries.withColumn("before", F.sum("rows").over(order) - F.col("rows")).filter(F.col("before") < enough)


def enough_deep(placed: DataFrame, spread: DataFrame, queries: DataFrame, ways: tuple, total: int, k: int, every: int, scratch: Scratch, settings: Settings) -> int:
    """enough_rows where leaves have trees of their own: budgets grow fourfold until they bring the stated share, then the least that does is taken."""
    near, q_ids, _ = true_neighbours(placed, k, every, settings)
    near = scratch.save(near.select("query_id", "vec_id"), "near")  # probes x k at most
    wanted = near.count()
    if not wanted:
        return 0
    at = F.broadcast(scratch.save(spread.join(F.broadcast(near.withColumnRenamed("vec_id", "id")), "id").select("query_id", "id", "tree", "leaf"), "wanted"))
    probes = scratch.save(queries.filter(F.col("id").isin(q_ids.tolist())), "probes")
    tried = 64 * settings.leaf
    while tried < settings.trees * total:
        got = reached(probes, *ways, tried, settings).select(F.col("id").alias("query_id"), "tree", "leaf", (F.col("before") + F.col("rows")).alias("need"))
        needs = [r.need for r in got.join(at, ["query_id", "tree", "leaf"]).groupBy("query_id", "id").agg(F.min("need").alias("need")).collect()]
        if (enough := budget(needs, wanted, settings.recall)) is not None:
            return enough
        tried *= 4
    return settings.trees * total


def search(spark: SparkSession, vectors: DataFrame, scratch: Scratch, k: int = 5, every: int = 50, settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each vec_id divisible by `every`, by cosine.

    The forest is fitted on a bounded sample; all rows are indexed. A leaf that still holds more than
    settings.most rows gets a tree of its own, fitted on its own rows and kept in a table, so leaves
    stay small in a table of any size; the queue goes on into those trees. A query reads leaves until they
    hold the budget's rows (see enough_rows): few where vectors form clusters, most of the table
    where they have no structure. The rows below a node, about settings.block of them, are a group;
    larger groups are cut into blocks, and a group's queries too, however hot either is. A query goes
    to the groups that hold leaves it reads, and brings k rows from each block. What is broadcast is
    bounded by the settings: the forest, the rows counted by leaf, the probes.

    Of equal vectors only the k + 1 smallest ids can be among a query's k nearest, itself left out;
    the others are queries, but no candidates, so a group of copies costs no pairs.

    Vectors null, empty, zero, or with null or non-finite components, and those of another dimension
    than the commonest (ties: the smaller), take no part; nor do rows of null id. Repeated rows of a
    vec_id: the smallest vector holds. Equal scores: the smaller vec_id is nearer, among what was
    found. Fewer candidates than k: all. Empty table: no rows.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & usable())
    v = scratch.save(v.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    dims = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    total = dims[0]["count"]
    v = v.filter(F.size("embedding") == dims[0]["d"])
    copy = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = v.withColumn("_copy", copy).filter(F.col("_copy") <= k + 1).select("vec_id", "embedding", F.lit(True).alias("candidate"))
    asked = v.filter(F.col("vec_id") % every == 0).select("vec_id", "embedding", F.lit(False).alias("candidate"))
    both = few.unionByName(asked)
    taken = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(settings.sample).toArrow()
    x = unit(matrix(taken.column("embedding")))
    depth = max(1, min(int(np.ceil(np.log2(max(2, total / settings.leaf)))), int(np.log2(max(2, len(x) / 8)))))
    forest = grow(x, depth, settings)
    shared = spark.sparkContext.broadcast(forest)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            x = unit(matrix(b.column("embedding")))
            at = shared.value.leaves(x)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("candidate"), pa.array([r.tobytes() for r in x], pa.binary()), pa.ListArray.from_arrays(np.arange(0, at.size + 1, at.shape[1], dtype=np.int32), at.ravel())], names=["vec_id", "candidate", "unit", "leaves"]
            )

    located = scratch.save(both.mapInArrow(locate, "vec_id long, candidate boolean, unit binary, leaves array<int>"), "placed")
    placed, queries = located.filter("candidate").drop("candidate"), located.filter("not candidate").drop("candidate")
    scratch.drop("vectors")
    by_leaf = placed.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").count().collect()  # trees x leaves at most
    rows = np.zeros((settings.trees, 1 << depth), np.int64)
    for r in by_leaf:
        rows[r.tree, r.leaf] = r["count"]
    counted, deep, enough = spark.sparkContext.broadcast(rows), int(rows.max()) > settings.most, settings.rows
    spread = placed.select(F.col("vec_id").alias("id"), "unit", F.posexplode("leaves").alias("tree", "leaf"))
    if deep:
        spread, counts, levels = deepen(spread.withColumn("leaf", F.col("leaf").cast("long")), scratch, settings)
        asks = queries.select(F.col("vec_id").alias("id"), "unit")
        if enough is None:
            enough = enough_deep(placed, spread, asks, (shared, counted, levels), total, k, every, scratch, settings)
    elif enough is None:
        enough = enough_rows(placed, forest, rows, k, every, settings)
    enough = max(enough, 8 * k)
    shift = depth - min(depth, max(0, int(np.ceil(np.log2(max(1, total / settings.block))))))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {n: [] for n in ("tree", "grp", "id", "unit", "leaves")}
            for i, u in zip(b.column("vec_id").to_pylist(), b.column("unit").to_pylist(), strict=True):
                groups: dict[tuple[int, int], list[int]] = {}
                for _, t, leaf in shared.value.search(np.frombuffer(u), counted.value, enough):
                    groups.setdefault((t, leaf >> shift), []).append(leaf)
                for (t, g), leaves in groups.items():
                    for n, value in zip(out, (t, g, i, u, leaves), strict=True):
                        out[n].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out["tree"], pa.int32()), pa.array(out["grp"], pa.int32()), pa.array(out["id"], pa.int64()), pa.array(out["unit"], pa.binary()), pa.array(out["leaves"], pa.list_(pa.int32()))], names=list(out))

    if deep:
        near_leaves = int(np.log2(max(1, min(FAN, settings.block / settings.leaf))))
        group = F.when(F.col("leaf") < FAN, F.shiftright("leaf", shift)).otherwise(-F.shiftright("leaf", near_leaves))
        entered = reached(asks, shared, counted, levels, enough, settings).withColumn("grp", group)
        routed = scratch.save(entered.groupBy("tree", "grp", "id").agg(F.collect_list("leaf").alias("leaves")).join(asks, "id"), "routed")
        sizes = counts.withColumn("grp", group).groupBy("tree", "grp").agg(F.sum("rows").alias("rows"))
        asking = routed.groupBy("tree", "grp").agg(F.count(F.lit(1)).alias("n"))
        facts = sizes.join(asking, ["tree", "grp"]).select("tree", "grp", F.ceil(F.col("rows") / settings.block).cast("int").alias("blocks"), F.ceil(F.col("n") / settings.queries).cast("int").alias("parts"))
        facts = scratch.save(facts, "facts")
    else:
        group = F.expr(f"shiftright(leaf, {shift})")
        routed = scratch.save(queries.mapInArrow(route, "tree int, grp int, id long, unit binary, leaves array<int>"), "routed")
        asking = {(r.tree, r.grp): r["count"] for r in routed.groupBy("tree", "grp").count().collect()}  # trees x groups at most
        size = rows.reshape(settings.trees, -1, 1 << shift).sum(axis=2)
        facts = [(t, g, int(-(-size[t, g] // settings.block)), -(-n // settings.queries)) for (t, g), n in asking.items()]
        facts = F.broadcast(spark.createDataFrame(facts, "tree int, grp int, blocks int, parts int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    some = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    columns = ["tree", "grp", "block", "part", "is_query", "id", "unit", "leaves"]
    sent = routed.join(facts, ["tree", "grp"]).withColumn("is_query", F.lit(True)).withColumn("part", some("parts")).withColumn("block", each("blocks")).select(columns)
    held = spread.withColumn("grp", group).join(facts, ["tree", "grp"])
    held = held.withColumn("is_query", F.lit(False)).withColumn("block", some("blocks")).withColumn("leaves", F.array("leaf")).withColumn("part", each("parts")).select(columns)

    def rerank(group: pa.Table) -> pa.Table:
        asks = group.column("is_query").combine_chunks()
        q, members = group.filter(asks), group.filter(pc.invert(asks))
        if not q.num_rows or not members.num_rows:
            return found(*[np.zeros(0)] * 3)
        x, ids, leaf = units(members.column("unit")), members.column("id").to_numpy(), members.column("leaves").combine_chunks().flatten().to_numpy()
        y, q_ids, wanted = units(q.column("unit")), q.column("id").to_numpy(), q.column("leaves").combine_chunks()
        owner = np.repeat(np.arange(len(q_ids)), pc.list_value_length(wanted).to_numpy())
        wanted = wanted.flatten().to_numpy()
        got = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for a in np.unique(wanted):
            here, who = np.flatnonzero(leaf == a), owner[wanted == a]
            for s in range(0, len(who), 512) if len(here) else ():
                w = who[s : s + 512]
                i, j, score = nearest(q_ids[w], y[w], ids[here], x[here], k)
                got.append((q_ids[w[i]], ids[here[j]], score))
        query, row, score = (np.concatenate(c) for c in zip(*got, strict=True))
        keep = best(query, row, score, k)
        return found(query[keep], row[keep], score[keep])

    near = sent.unionByName(held).groupBy("tree", "grp", "block", "part").applyInArrow(rerank, FOUND)
    near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
