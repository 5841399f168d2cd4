"""Embedding near-duplicates within a label: int8 tile products with rigorous error bounds, full precision where these leave a doubt."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import matrix, unit, usable
from .common import Scratch
from .components import components

#: Room for the rounding of the bounds themselves (sums of a few thousand doubles near 1).
SLACK = 1e-9


@dataclass
class Settings:
    """tile: vectors a side of a tile at most, on average; strip: rows of a tile multiplied at once."""

    least: float = 0.98
    tile: int = 2048
    strip: int = 512


@dataclass
class Quantised:
    """Unit vectors x = scale * q + e with int8 q, |e| <= error and |scale * q| <= size."""

    q: np.ndarray
    scale: np.ndarray
    error: np.ndarray
    size: np.ndarray


def quantise(x: np.ndarray) -> Quantised:
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    norm = lambda a: np.sqrt(np.einsum("ij,ij->i", a, a)) * (1 + 1e-12) + 1e-15
    return Quantised(q, scale, norm(x - back), norm(back))


def links(x: np.ndarray, y: np.ndarray, same: bool, settings: Settings):
    """Yields (row of x, row of y) arrays of the pairs with cosine >= least, strip by strip; if `same`, each pair once.

    |x.y - sx sy qx.qy| <= |sx qx| ey + ex |sy qy| + ex ey. Integer products are exact in float32
    while dimension * 127**2 < 2**24, else in float64. Pairs below by more than the bound are none,
    pairs above by more are links, and only those between are computed from the vectors.
    """
    kind = np.float32 if x.shape[1] * 127**2 < 2**24 else np.float64
    a, b = quantise(x), quantise(y)
    right = b.q.astype(kind).T
    for s in range(0, len(x), settings.strip):
        e = min(s + settings.strip, len(x))
        near = (a.q[s:e].astype(kind) @ right) * a.scale[s:e, None] * b.scale
        bound = a.size[s:e, None] * b.error + a.error[s:e, None] * (b.size + b.error) + SLACK
        maybe = near >= settings.least - bound
        if same:
            maybe &= np.arange(s, e)[:, None] < np.arange(len(y))
        i, j = maybe.nonzero()
        sure = near[i, j] - bound[i, j] >= settings.least
        keep = [(i[sure], j[sure])]
        doubt_i, doubt_j = i[~sure], j[~sure]
        for t in range(0, len(doubt_i), 65536):
            di, dj = doubt_i[t : t + 65536], doubt_j[t : t + 65536]
            yes = np.einsum("ij,ij->i", x[s + di], y[dj]) >= settings.least
            keep.append((di[yes], dj[yes]))
        yield s + np.concatenate([k[0] for k in keep]), np.concatenate([k[1] for k in keep])


def forest(n: int, strips) -> np.ndarray:
    """The smallest member of each of n nodes' component, from strips of (node, node) arrays."""
    root = np.arange(n)
    for i, j in strips:
        while len(i):
            a, b = root[i], root[j]
            differ = a != b
            if not differ.any():
                break
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(root, up := root[root]):
                root = up
    return root


def near_duplicates(vectors: DataFrame, scratch: Scratch, settings: Settings = Settings()) -> DataFrame:
    """A row per vector: n_links, component_id (smallest vec_id reachable by links), kept.

    A label's rows are cut into blocks of about settings.tile, and each pair of blocks is a task's
    group, however hot the label. A tile returns a row per vector that has a link in it: the number
    of its links and the smallest vec_id of its component within the tile; no pairs leave it.

    Null label, or a vector that is null, empty, zero or holds null or non-finite components: no
    links. Vectors of different dimension do not link. Repeated rows of a vec_id: the smallest
    (label, vector) holds, one row results. Null vec_id: a row each, no links, null component, kept.
    Empty table: no rows. Other columns are not read.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    v = scratch.save(v.filter("vec_id is not null").groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("_v")).select("vec_id", "_v.*"), "vectors")
    good = v.filter(F.col("label").isNotNull() & usable()).withColumn("dim", F.size("embedding"))
    blocks = good.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / settings.tile).cast("int").alias("blocks"))
    dealt = good.join(blocks, ["label", "dim"]).withColumn("_own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", "dim", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "_own", "vec_id", "embedding")

    def tile(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        i, j = key[2].as_py(), key[3].as_py()
        group = group.sort_by("vec_id")
        ids, own = group.column("vec_id").to_numpy(), group.column("_own").to_numpy()
        x = unit(matrix(group.column("embedding")))
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        count, strips = np.zeros(len(ids), np.int64), []
        for a, b in links(x[left], x[right], i == j, settings) if len(left) and len(right) else ():
            a, b = left[a], right[b]
            count += np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
            strips = [(np.arange(len(ids)), forest(len(ids), [*strips, (a, b)]))]
        root = forest(len(ids), strips)
        some = count > 0
        return pa.Table.from_pandas(pd.DataFrame({"vec_id": ids[some], "n": count[some], "least": ids[root[some]]}), preserve_index=False)

    found = scratch.save(dealt.groupBy("label", "dim", "i", "j").applyInArrow(tile, "vec_id long, n long, least long"), "found")
    of = components(found.filter("least <> vec_id").select(F.col("vec_id").alias("a"), F.col("least").alias("b")), scratch)
    total = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    out = v.select("vec_id").join(total, "vec_id", "left").join(of.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    out = out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
    blank = vectors.filter("vec_id is null").select(F.lit(None).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(blank)


#: near_duplicates over the embeddings table in DuckDB's SQL.
NEAR_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v WHERE label IS NOT NULL),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM reach r JOIN link l ON l.a = r.other),
smallest AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
counted AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, s.component_id, v.vec_id = s.component_id AS kept
FROM v JOIN smallest s USING (vec_id) LEFT JOIN counted c USING (vec_id)
"""
