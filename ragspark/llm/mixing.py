"""Mixing sources to target weights by systematic sampling (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

#: Groups up to this many (counted) are broadcast, so that documents are shuffled once; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Salts by which every group of equally long documents is split.
SALTS = 32
#: Rows that a task sorts: a salted group that was counted to hold more is split again, by as many parts as that takes.
GROUP_ROWS = 100_000


def word_count(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _number(text: Column, start: int = 1) -> Column:
    """32 bits of a text's MD5, from that hex digit on, as a long."""
    return F.conv(F.substring(F.md5(text.cast("binary")), start, 8), 16, 10).cast("long")


def _same(*pairs: tuple[str, str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in pairs])


def _split(d: DataFrame, counted: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Documents with their _part, and the counts by it: salted groups of more than `most` rows are cut by further bits of the id's hash.

    Only those are counted a second time. What is broadcast is a row a large group, and those are checked.
    """
    large = counted.filter(F.col("_n") > most).select(F.col("source").alias("_s"), F.col("_class").alias("_c"), F.col("_salt").alias("_z"), F.ceil(F.col("_n") / most).alias("_parts"))
    n = large.limit(BROADCAST_ROWS + 1).count()
    if not n:
        return d.withColumn("_part", F.lit(0).cast("long")), counted.withColumn("_part", F.lit(0).cast("long"))
    part = F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(_number(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 9) % F.col("_parts")).cast("long")
    d = d.join(F.broadcast(large) if n <= BROADCAST_ROWS else large, _same(("source", "_s"), ("_class", "_c"), ("_salt", "_z")), "left").withColumn("_part", part)
    again = d.filter(F.col("_parts").isNotNull()).groupBy("source", "_class", "_salt", "_part").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("size"))
    return d.drop("_s", "_c", "_z", "_parts"), counted.filter(F.col("_n") <= most).withColumn("_part", F.lit(0).cast("long")).unionByName(again)


def targets(sized: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """A row per source: _source_size, _target.

    Sources in code-point order, null last, take the weights in turn and divide `share` times all
    sizes; a target stops at `cap` times its source's size and what is over goes to the others by
    weight. Sorted by cap over weight, a source is capped if the level that those from it on would
    get reaches its cap, so one pass over the (few) sources finds the level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everywhere = Window.partitionBy()
    k = (F.row_number().over(order) - 1) % len(weights)
    weight = reduce(lambda c, i: c.when(k == i, F.lit(float(weights[i]))), range(1, len(weights)), F.when(k == 0, F.lit(float(weights[0]))))
    s = sized.groupBy("source").agg(F.sum("size").alias("_source_size")).withColumn("_w", weight)
    s = s.withColumn("_cap", F.lit(cap) * F.col("_source_size")).withColumn("_all", F.lit(share) * F.sum("_source_size").over(everywhere))
    s = s.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    up = Window.orderBy(F.col("_ratio"), F.col("source").asc_nulls_last())
    before, on = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(on)
    s = s.withColumn("_capped", level >= F.col("_ratio"))
    rest = F.col("_all") - F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_cap"))).over(everywhere), F.lit(0.0))
    free = F.sum(F.when(~F.col("_capped"), F.col("_w"))).over(everywhere)
    target = F.when(F.col("_capped"), F.col("_cap")).otherwise(F.least(F.col("_cap"), rest / free * F.col("_w")))
    return s.select("source", "_source_size", target.alias("_target"))


def mix_sources(sized: DataFrame, keep: Callable[[DataFrame, str], DataFrame], seed: str = "mix", weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, most: int = GROUP_ROWS) -> DataFrame:
    """`sized` (doc_id, source, size and whatever else) with source_size, target, copies, taken.

    Each source's documents stand in order of length class, salt, part, length and id; a document's
    expected copies are target / source_size, their prefix sum plus one random offset a source
    (from `seed`, so reruns agree) emits a copy for each integer boundary crossed. Order by length
    keeps the words taken near the target. A hot source is no single task: groups are (source,
    length class, salt), only their counts meet by source, and those are bounded by classes x salts.
    `keep(df, name)` stores the groups' table; the documents themselves are shuffled once.

    Null text: size 0. Null source: a source of its own, last. A source without words: target 0,
    nothing taken. Null doc_id: an id before all others. Repeated rows count and are taken each for
    itself. Empty table: no rows. Other columns pass through; those of the names that are added, or
    that are used inside (_class, _salt, _part, _parts, _rank, _s, _c, _z, _p, _before, _target, _source_size), do not.
    """
    own = ("source_size", "target", "copies", "taken", "_class", "_salt", "_part", "_parts", "_rank", "_s", "_c", "_z", "_p", "_before", "_target", "_source_size")
    d = sized.drop(*own).withColumn("_class", F.floor(F.sqrt("size")))
    d = d.withColumn("_salt", _number(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % SALTS)
    # Only groups are read from here on: one pass over the documents counts them, with their words.
    counted = keep(d.groupBy("source", "_class", "_salt").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("size")), "groups")
    goals = targets(counted.select("source", "size"), weights, share, cap)
    d, parts = _split(d, counted, most)
    running = Window.partitionBy("source").orderBy("_class", "_salt", "_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    groups = parts.drop("size").withColumn("_before", F.sum("_n").over(running) - F.col("_n")).drop("_n")
    groups = groups.alias("g").join(goals.alias("t"), F.col("g.source").eqNullSafe(F.col("t.source"))).select("g.*", "_source_size", "_target")
    groups = keep(groups.withColumnsRenamed({"source": "_s", "_class": "_c", "_salt": "_z", "_part": "_p"}), "placed")
    if groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        groups = F.broadcast(groups)
    d = d.withColumn("_rank", F.row_number().over(Window.partitionBy("source", "_class", "_salt", "_part").orderBy("size", "doc_id")))
    d = d.join(groups, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_c")) & (F.col("_salt") == F.col("_z")) & (F.col("_part") == F.col("_p")))
    each = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    offset = _number(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("\0")))) / F.lit(4294967296.0)
    at = F.col("_before") + F.col("_rank")
    copies = F.least(F.floor(offset + each * at) - F.floor(offset + each * (at - 1)), F.ceil(each)).cast("long")
    d = d.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return d.withColumnsRenamed({"_source_size": "source_size", "_target": "target"}).drop("_class", "_salt", "_part", "_rank", "_s", "_c", "_z", "_p", "_before")


#: mix_sources over the documents table, with its defaults, in DuckDB's SQL.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
grouped AS (
  SELECT *, CAST(floor(sqrt(size)) AS BIGINT) AS class, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) % 32 AS salt FROM sized),
parted AS (
  SELECT *, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 9, 8)) AS BIGINT) % CAST(ceil(count(*) OVER (PARTITION BY source, class, salt) / 100000.0) AS BIGINT) AS part FROM grouped),
weighted AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS ss, CASE (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM sized GROUP BY source),
capped AS (
  SELECT *, 1.5::DOUBLE * sum(ss) OVER () AS total,
    (1.5::DOUBLE * sum(ss) OVER () - coalesce(sum(2.0::DOUBLE * ss) OVER (ORDER BY 2.0::DOUBLE * ss / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY 2.0::DOUBLE * ss / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) >= 2.0::DOUBLE * ss / w AS is_capped FROM weighted),
goal AS (
  SELECT source, ss, CASE WHEN is_capped THEN 2.0::DOUBLE * ss ELSE least(2.0::DOUBLE * ss, (total - coalesce(sum(CASE WHEN is_capped THEN 2.0::DOUBLE * ss END) OVER (), 0)) / sum(CASE WHEN NOT is_capped THEN w END) OVER () * w) END AS target FROM capped),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, salt, part, size, doc_id) AS pos FROM parted),
shares AS (
  SELECT r.doc_id, r.size, g.ss, g.target, r.pos, CASE WHEN g.ss > 0 THEN g.target / g.ss ELSE 0 END AS each,
    CAST(('0x' || substr(md5('mix:' || coalesce(r.source, chr(0))), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS off
  FROM ranked r JOIN goal g ON r.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, CAST(ss AS BIGINT) AS source_size, target,
  CAST(least(floor(off + each * pos) - floor(off + each * (pos - 1)), ceil(each)) AS BIGINT) AS copies,
  CAST(least(floor(off + each * pos) - floor(off + each * (pos - 1)), ceil(each)) AS BIGINT) * size AS taken
FROM shares
"""
