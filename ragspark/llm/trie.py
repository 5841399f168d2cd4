"""The prefix trie of conversations: owned chains found by binary search over prefix digests' minima, aggregated bottom-up."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, arrow_out


@dataclass
class Settings:
    """family: conversations of one base (the smallest of so many numbers); shared: the base's first turns that others may
    take over are fewer than this; segment: turns of a conversation summed in one task; bits: an end's list is
    put together from buckets of 2 ** bits consecutive conversation numbers."""

    family: int = 20
    shared: int = 4
    segment: int = 4096
    bits: int = 16


#: SHA-256 of nothing: no conversation ends at the node.
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """The lengths part role from text, so no two turns share what is hashed."""
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, part, place, digest, words: turns in order; place counts a conversation's turns within a part (a task of the sort).

    A range partitioning by conversation, turn and digest cuts a conversation of any length into
    parts; rows equal in all of these are alike, so a row's number may part them.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    t = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn_digest(role, text).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("row")]
    t = t.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("place", pa.int64()), ("digest", pa.string()), ("words", pa.int64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count = TaskContext.get().partitionId(), None, 0
        for b in batches:
            ids = b.column("conv_id").to_numpy()
            if not len(ids):
                continue
            first = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
            place = np.arange(1, len(ids) + 1) - np.repeat(first, np.diff(np.append(first, len(ids))))
            if ids[0] == last:
                place[: first[1] if len(first) > 1 else len(ids)] += count
            last, count = ids[-1], int(place[-1])
            yield arrow_out(schema, {"conv_id": ids, "part": np.full(len(ids), part), "place": place, "digest": b.column("digest"), "words": b.column("words")})

    return t.select("conv_id", "digest", "words").mapInArrow(each, "conv_id long, part long, place long, digest string, words long")


def before(rows: DataFrame, key: str, by: str, **sums: Column) -> DataFrame:
    """key, by and, of each column, the sum (or bit_xor) over the key's earlier `by`; the first of each key is left out.

    A key has a row per task or segment here, not per turn.
    """
    w = Window.partitionBy(key).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.select(key, by, *(c.over(w).alias(n) for n, c in sums.items()))
    return out.filter(F.col(next(iter(sums))).isNotNull())


def positions(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, pos (from 1), digest, words."""
    t = scratch.save(ordered(conversations), "ordered")
    counts = t.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    # One row a part at most has a conversation begun in another: as many rows as tasks.
    carried = before(counts, "conv_id", "part", carry=F.sum("n"))
    t = t.join(carried, ["conv_id", "part"], "left")
    return scratch.save(t.select("conv_id", (F.col("place") + F.coalesce("carry", F.lit(0))).alias("pos"), "digest", "words"), "turns")


def rebuilt(turns: DataFrame, scratch: Scratch, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n) with the number of rebuilt turns, and (conv_id, depth, digest, words) of them."""
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = convs.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % settings.shared).withColumn("base", F.col("conv_id") - F.col("conv_id") % settings.family)
    sizes = convs.filter("conv_id = base").select("base", F.col("n").alias("n_base"))
    convs = convs.join(sizes, "base", "left").withColumn("k", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = scratch.save(convs.select("conv_id", "base", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")), "convs")
    heads = turns.filter((F.col("pos") < settings.shared) & (F.col("conv_id") % settings.family == 0)).select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "digest", "words")
    taken = convs.filter("k > 0").select("conv_id", "base", "k").join(heads, "base").filter("depth <= k").select("conv_id", "depth", "digest", "words")
    # Only where the base is short (or absent) do own turns move; those few conversations are joined, not all.
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % settings.shared
    moved = convs.filter("k < h").select("conv_id", (F.col("h") - F.col("k")).alias("up"))
    own = turns.filter(F.col("pos") > h).join(moved, "conv_id", "left").select("conv_id", (F.col("pos") - F.coalesce("up", F.lit(0))).alias("depth"), "digest", "words")
    return convs.select("conv_id", "n"), taken.unionByName(own)


def prefixes(convs: DataFrame, turns: DataFrame, scratch: Scratch, settings: Settings) -> DataFrame:
    """conv_id, depth (from 0), a, b, words: 128 bits of each prefix's digest, and the last turn's words.

    A prefix is the exclusive or of hashes of its (depth, turn) pairs, so that a long conversation's
    segments are summed apart and put together by what comes before each.
    """
    hashed = turns.select("conv_id", "depth", F.xxhash64("depth", "digest").alias("x"), F.xxhash64("digest", "depth", F.lit("second")).alias("y"), "words", F.expr(f"(depth - 1) div {settings.segment}").alias("segment"))
    w = Window.partitionBy("conv_id", "segment").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = scratch.save(hashed.select("conv_id", "depth", "segment", F.bit_xor("x").over(w).alias("a"), F.bit_xor("y").over(w).alias("b"), "words"), "local")
    ends = local.filter(F.col("depth") % settings.segment == 0).select("conv_id", F.col("segment") + 1, "a", "b").toDF("conv_id", "segment", "a", "b")
    w = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = ends.select("conv_id", "segment", F.bit_xor("a").over(w).alias("ca"), F.bit_xor("b").over(w).alias("cb"))
    later = local.filter("segment > 0").join(carried, ["conv_id", "segment"]).select("conv_id", "depth", F.expr("a ^ ca").alias("a"), F.expr("b ^ cb").alias("b"), "words")
    root = convs.select("conv_id", *(F.lit(0).cast("long").alias(c) for c in ("depth", "a", "b", "words")))
    return scratch.save(local.filter("segment = 0").select("conv_id", "depth", "a", "b", "words").unionByName(later).unionByName(root), "prefixes")


def first_owned(convs: DataFrame, prefix: DataFrame, minima: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, n, first: the least depth whose prefix has the conversation as its smallest member (n + 1: none has).

    Who is smallest at a depth is so below it too, since members only leave. So each conversation
    halves its own interval: a round looks up one prefix of every conversation that is still open, in
    two joins; rounds grow with the logarithm of the longest one.
    """
    state, settled, k = convs.select("conv_id", "n", F.lit(0).cast("long").alias("low"), (F.col("n") + 1).alias("high")), None, 0
    while True:
        asked = state.withColumn("depth", F.expr("(low + high) div 2")).join(prefix.drop("words"), ["conv_id", "depth"]).join(minima.select("depth", "a", "b", "owner"), ["depth", "a", "b"])
        mine = F.col("owner") == F.col("conv_id")
        halved = asked.select("conv_id", "n", F.when(mine, F.col("low")).otherwise(F.col("depth") + 1).alias("low"), F.when(mine, F.col("depth")).otherwise(F.col("high")).alias("high"))
        halved = scratch.save(halved, f"halved{k}")
        done = halved.filter("low = high").select("conv_id", "n", F.col("low").alias("first"))
        settled = done if settled is None else settled.unionByName(done)
        state, k = halved.filter("low < high"), k + 1
        if state.isEmpty():
            return settled


def chain_totals(chains: DataFrame, scratch: Scratch) -> DataFrame:
    """chain, leaves, saved: sums over each chain and all chains below it; chains: chain, up (its parent chain, null at the top), leaves, saved.

    After round k a chain holds the sums of those less than 2**k below it and a pointer 2**k up, so
    rounds grow with the logarithm of the height.
    """
    now, k = chains.withColumnRenamed("up", "jump"), 0
    while True:
        now = scratch.save(now, f"totals{k}")
        if k > 1:
            scratch.drop(f"totals{k - 2}")
        climbing = now.filter("jump is not null")
        if climbing.isEmpty():
            return now.select("chain", "leaves", "saved")
        below = climbing.groupBy(F.col("jump").alias("chain")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        further = climbing.select(F.col("chain").alias("jump"), F.col("jump").alias("next"))
        now = now.join(further, "jump", "left").join(below, "chain", "left")
        now, k = now.select("chain", F.col("next").alias("jump"), *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved"))), k + 1


def list_digests(ends: DataFrame, settings: Settings) -> DataFrame:
    """owner, depth, sha: SHA-256 of the conversation numbers that end at a node, ascending and joined by commas.

    Buckets of consecutive numbers become strings of bounded length wherever they lie; a node's
    strings then pass in order through one running hash, which holds none of them.
    """
    bucket = F.shiftright("conv_id", settings.bits)
    joined = ends.groupBy("owner", "depth", bucket.alias("bucket")).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))).alias("part"))
    schema = pa.schema([("owner", pa.int64()), ("depth", pa.int64()), ("sha", pa.string())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, None
        for b in batches:
            out = []
            for owner, depth, part in zip(*(b.column(c).to_pylist() for c in ("owner", "depth", "part")), strict=True):
                if key == (owner, depth):
                    running.update(b",")
                else:
                    if key:
                        out.append((*key, running.hexdigest()))
                    key, running = (owner, depth), hashlib.sha256()
                running.update(part.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if key:
            yield arrow_out(schema, {"owner": [key[0]], "depth": [key[1]], "sha": [running.hexdigest()]})

    return joined.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "bucket").select("owner", "depth", "part").mapInArrow(each, "owner long, depth long, sha string")


def prefix_trie(conversations: DataFrame, scratch: Scratch, settings: Settings = Settings()) -> DataFrame:
    """A row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    The nodes are the distinct prefixes of the rebuilt conversations, each owned by its smallest
    member. What one conversation owns is a chain, from its first owned depth (by binary search) to
    its end; a chain hangs below the node of its first owned depth less one. Leaves and saved tokens
    are summed over a chain's own nodes, over the chains below it by doubling, and from the end of
    each chain up to each of its nodes, segment by segment.

    Null turns come first; turns of one conversation and number are ordered by the SHA-256 of their
    role and text; repeated rows are turns each. Null roles and texts are empty. Rows of a null
    conv_id are no conversation. A conversation whose base is absent begins after its own first h
    turns, and may have none. Empty table: no rows, since no conversation holds the root. Other
    columns are not read.
    """
    turns = positions(conversations, scratch)
    convs, whole = rebuilt(turns, scratch, settings)
    prefix = prefixes(convs, whole, scratch, settings)
    minima = scratch.save(prefix.groupBy("depth", "a", "b").agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words")), "minima")
    found = first_owned(convs, prefix, minima, scratch)
    # One more batched look-up: who owns the node above the first owned one.
    above = found.filter("first > 0").withColumn("depth", F.col("first") - 1).join(prefix.drop("words"), ["conv_id", "depth"]).join(minima.select("depth", "a", "b", "owner"), ["depth", "a", "b"])
    found = scratch.save(above.select("conv_id", "n", "first", F.col("owner").alias("up")).unionByName(found.filter("first = 0").select("conv_id", "n", "first", F.lit(None).cast("long").alias("up"))), "found")
    chains = found.filter("first <= n")
    nodes = minima.select("owner", "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("saves"))

    hung = chains.filter("up is not null").groupBy(F.col("up").alias("owner"), (F.col("first") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("hung"))
    tips = chains.select(F.col("conv_id").alias("owner"), F.col("n").alias("depth"))
    own = tips.join(hung, ["owner", "depth"], "left").select("owner", F.when(F.col("hung").isNull(), 1).otherwise(0).cast("long").alias("leaves"))
    saved = nodes.groupBy("owner").agg(F.sum("saves").alias("saved"))
    totals = chain_totals(chains.select(F.col("conv_id").alias("chain"), "up").join(own.withColumnRenamed("owner", "chain"), "chain").join(saved.withColumnRenamed("owner", "chain"), "chain"), scratch)

    # What meets at single nodes: tops and tips of chains, chains that hang there, conversations that end there.
    ended = found.select(F.when(F.col("first") <= F.col("n"), F.col("conv_id")).otherwise(F.col("up")).alias("owner"), F.col("n").alias("depth"), "conv_id")
    none = {c: F.lit(None).cast(t).alias(c) for c, t in (("parent", "long"), ("tip", "long"), ("hung", "long"), ("leaves", "long"), ("saved", "long"), ("sha", "string"))}
    at = lambda df, **given: df.select("owner", "depth", *(given[c].alias(c) if c in given else none[c] for c in none))
    below = chains.filter("up is not null").join(totals.withColumnRenamed("chain", "conv_id"), "conv_id").groupBy(F.col("up").alias("owner"), (F.col("first") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("hung"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    marks = at(chains.select(F.col("conv_id").alias("owner"), F.col("first").alias("depth"), "up"), parent=F.col("up"))
    marks = marks.unionByName(at(tips, tip=F.lit(1).cast("long"))).unionByName(at(below, hung=F.col("hung"), leaves=F.col("leaves"), saved=F.col("saved"))).unionByName(at(list_digests(ended, settings), sha=F.col("sha")))
    marks = marks.groupBy("owner", "depth").agg(*(F.max(c).alias(c) for c in none))

    n = nodes.join(marks, ["owner", "depth"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    leaf = F.when(F.col("tip").isNotNull() & F.col("hung").isNull(), 1).otherwise(0)
    n = n.select("owner", "depth", "n_convs", F.when(F.col("depth") > 0, F.coalesce("parent", "owner")).alias("parent"), (zero("hung") + F.when(F.col("tip").isNull(), 1).otherwise(0)).alias("n_children"), (zero("leaves") + leaf).alias("leaves"), (zero("saved") + F.col("saves")).alias("saved"), F.coalesce("sha", F.lit(NOTHING)).alias("sha"), F.expr(f"depth div {settings.segment}").alias("segment"))
    w = Window.partitionBy("owner", "segment").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = scratch.save(n.withColumns({c: F.sum(c).over(w) for c in ("leaves", "saved")}), "nodes")
    # A segment's sums at its least depth are what the segments before it add; chains within one segment have none.
    least = n.groupBy("owner", "segment").agg(F.max("leaves").alias("leaves"), F.max("saved").alias("saved"))
    later = before(least.withColumn("back", -F.col("segment")), "owner", "back", leaves_after=F.sum("leaves"), saved_after=F.sum("saved"))
    n = n.join(later.select("owner", (-F.col("back")).alias("segment"), "leaves_after", "saved_after"), ["owner", "segment"], "left")
    return n.select(F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.col("n_children").cast("long").alias("n_children"), (F.col("leaves") + zero("leaves_after")).alias("n_leaves"), (F.col("saved") + zero("saved_after")).alias("saved_tokens"), F.col("sha").alias("ends_sha256"))


#: prefix_trie over the conversations table in DuckDB's SQL. crc32 goes bit by bit: -1 is a bit's step, other entries are characters.
TRIE_SQL = """
WITH turns AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
original AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS t FROM turns GROUP BY conv_id),
hashed AS (
  SELECT conv_id, t, conv_id - conv_id % 20 AS base,
    xor(list_reduce(flatten([[CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
      lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))]),
      lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295) % 4 AS h
  FROM original),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.t[1:c.h], []), c.t[c.h + 1:]) AS t FROM hashed c LEFT JOIN original b ON b.conv_id = c.base),
member AS (SELECT conv_id, unnest(range(len(t) + 1)) AS depth, t FROM rebuilt),
node AS (
  SELECT depth, t[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(t) = depth), '')) AS ends_sha256
  FROM member GROUP BY depth, path),
valued AS (
  SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(path[depth].text, '[^\\x20\\x09-\\x0D]+')) END AS saves FROM node),
kids AS (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL),
marked AS (SELECT v.*, coalesce(k.n, 0) AS n_children FROM valued v LEFT JOIN kids k ON k.depth = v.depth AND k.path = v.path),
over_all AS (
  SELECT up AS depth, path[1:up] AS path, sum(CAST(n_children = 0 AS BIGINT)) AS n_leaves, sum(saves) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS up FROM marked) GROUP BY ALL)
SELECT m.conv_id, m.depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(o.n_leaves AS BIGINT) AS n_leaves, CAST(o.saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
FROM marked m JOIN over_all o ON o.depth = m.depth AND o.path = m.path
LEFT JOIN node p ON p.depth = m.depth - 1 AND p.path = m.path[1:m.depth - 1]
"""
