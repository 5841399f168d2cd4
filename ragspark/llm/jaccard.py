"""N-gram Jaccard join by token-combination prefixes.

A document is its set of distinct 3-word shingles (64-bit hashes). All documents' shingles are
counted in a fixed number of buckets; a bucket's level grows with its count, and the top level's
shingles are the frequent class, the others the rare one. The global order is by level, then by
hash, so prefixes hold the rarest. Let x be a set of n shingles, t the threshold, a = n - ceil(t n) the
most shingles of x that a partner can miss, and D = floor(n (1 - t) / t) the most that the two can
differ by in all. The signatures of x come from a prefix of its order:

* with at least a + k rare shingles, the first a + k, each a signature: k must be shared;
* else all its rare shingles (r of them, each a signature), and the first 2 (D - r) + 2 frequent
  ones, of which each two neighbours are a signature. If no rare one is shared, r differences are
  spent; each of the D - r others breaks at most two neighbourhoods, and one is left.

Of two linked sets, take the one whose prefix ends first: what it shares lies in the other's prefix
too, so both have the signature. For t >= 0.8 a set always has enough shingles, or D = 0 and only an
equal set links. So no link is lost, whatever the classes; they only make shared signatures rare.

k grows with n (extra()), and a set of the first kind is out at once if fewer of its signatures occur
elsewhere than the k of the smallest set that it may link with: chance shares a few, copies many.

Documents with equal sets are one before signatures are compared. A signature's sets are compared
with its smallest one; what that links is joined, and only sets in different components that still
share a signature are compared in pairs. So a group of copies costs a comparison a copy. Before
two sets meet, their sizes and parity maps must allow it: bit i of a map is the parity of the
shingles that hash to i, so each shingle that only one set has changes one bit at most, and two maps
that differ in more bits than the sets may differ in shingles are of sets that do not link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Scratch, hash_words, mix, release, runs, shingles, text_column, trim, words_of
from .components import components

#: Buckets travel in so many blocks.
BLOCKS = 64
#: Bits of a parity map, and the level of the frequent class.
PARITY = 1024
TOP = 255


@dataclass
class Settings:
    """least: the threshold in per cent; bits: 2**bits buckets count the shingles; id_bits: of the map of documents to read again, at most.

    However many shingles share a bucket, one that occurs more often than chance makes buckets differ
    is in the top class (see limit in read()): in a larger corpus that is a larger number.
    """

    words: int = 3
    least: int = 90
    bits: int = 23
    id_bits: int = 27


def set_key(s: np.ndarray) -> int:
    """A 64-bit name of a set, as a signed long."""
    return xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s)) - (1 << 63)


def text_sets(batch: pa.RecordBatch, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of each of the batch's texts."""
    words, codes, ends = words_of(text_column(batch))
    hashes = hash_words(words)
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield shingles(hashes[codes[a:b]], n)


def allowed(n: int, least: int) -> tuple[int, int]:
    """a and D of the module's text, in whole numbers."""
    return n - -(-n * least // 100), n * (100 - least) // least


def extra(n: int, least: int) -> int:
    """k of the module's text: a twentieth of the set more, at most all that a partner must have."""
    return min(n // 20 + 1, n - allowed(n, least)[0])


def needed(n: int, least: int) -> int:
    """How many signatures a set of the first kind shares at least with any set it links with."""
    return extra(-(-n * least // 100), least)


def signatures(s: np.ndarray, levels: np.ndarray, least: int) -> tuple[np.ndarray, int]:
    """Of a sorted set, and how many of them must occur elsewhere; `levels`: by bucket, the leading bits of a shingle."""
    n = len(s)
    miss, differ = allowed(n, least)
    if not differ:
        return s[:0], 1
    level = levels[s >> np.uint64(64 - int(np.log2(len(levels))))]
    often = level == TOP
    rare = int(n - often.sum())
    if rare >= miss + extra(n, least):
        return s[np.argsort(level, kind="stable")[: miss + extra(n, least)]], needed(n, least)
    f = s[often][: max(0, 2 * (differ - rare) + 2)]
    return np.concatenate([s[~often], mix(mix(f[:-1]) + f[1:])]), 1


def parity(s: np.ndarray) -> np.ndarray:
    """The set's parity map as signed longs."""
    odd = np.bincount((mix(s) & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def block_rows(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """block, counts: a count by bucket in BLOCKS blocks, byte by byte of all (upper bytes are zeros and compress away)."""
    parts = counts.reshape(BLOCKS, -1)
    some = [b for b in range(BLOCKS) if parts[b].any()]
    for i in range(0, len(some), 2):
        packed = [parts[b].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for b in some[i : i + 2]]
        yield pa.RecordBatch.from_arrays([pa.array(some[i : i + 2], pa.int32()), pa.array(packed, pa.binary())], names=["block", "counts"])


def summed(rows: DataFrame, bits: int, level: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The blocks' sums, made levels (bytes) where they are summed; the driver gets 2**bits bytes."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, data in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total[b] = total.get(b, 0) + np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([level(x).astype(np.uint8).tobytes() for x in total.values()], pa.binary())], names=["block", "levels"])

    out = np.zeros((BLOCKS, (1 << bits) // BLOCKS), np.uint8)
    for r in rows.repartition(BLOCKS, "block").mapInArrow(add, "block int, levels binary").collect():
        out[r.block] = np.frombuffer(r.levels, np.uint8)
    return out.ravel()


class Join:
    """The steps of the join over `docs` (doc_id, text), with tables in `scratch`."""

    def __init__(self, spark: SparkSession, docs: DataFrame, scratch: Scratch, settings: Settings = Settings()):
        self.spark, self.scratch, self.settings = spark, scratch, settings
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id").alias("id_hash"), "text")

    def read(self) -> DataFrame:
        """doc_id, id_hash, n, set_key, parity of every document; and, by the way, the shingles' levels."""
        s = self.settings

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()
            names = ["doc_id", "id_hash", "n", "set_key", "parity", "block", "counts"]
            counts, known = np.zeros(1 << s.bits, np.uint32), set()
            for part in runs(batches):
                sizes, keys, maps = [], [], []
                for x in text_sets(part, s.words):
                    sizes.append(len(x))
                    keys.append(set_key(x))
                    maps.append(parity(x))
                    if keys[-1] not in known:
                        known.add(keys[-1])
                        np.add.at(counts, (x >> np.uint64(64 - s.bits)).view(np.int64), np.uint32(1))
                blank = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("id_hash"), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(maps, pa.list_(pa.int64())), pa.nulls(blank, pa.int32()), pa.nulls(blank, pa.binary())], names=names)
            for rows in block_rows(counts):
                n = rows.num_rows
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64())] * 4 + [pa.nulls(n, pa.list_(pa.int64())), rows.column(0), rows.column(1)], names=names)
            trim()

        both = self.scratch.save(self.docs.mapInArrow(each, "doc_id long, id_hash long, n long, set_key long, parity array<long>, block int, counts binary"), "read")
        sets = both.filter("block is null").select("doc_id", "id_hash", "n", "set_key", "parity")
        total = sets.groupBy("set_key").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0] or 0
        mean = total / (1 << s.bits)
        limit = mean + 8 * mean**0.5 + 8
        self.levels = summed(both.filter("block is not null").select("block", "counts"), s.bits, lambda x: np.minimum(TOP, x * TOP / limit))
        return sets

    def postings(self) -> DataFrame:
        """signature, set_key, need: of each document (equal sets of one task once)."""
        s, levels = self.settings, self.spark.sparkContext.broadcast(self.levels)  # 2**bits bytes

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()
            known: set[int] = set()
            for part in runs(batches):
                found, keys, needs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
                for x in text_sets(part, s.words):
                    key = set_key(x)
                    if key not in known:
                        known.add(key)
                        own, need = signatures(x, levels.value, s.least)
                        found.append(own)
                        keys.append(np.full(len(own), key, np.int64))
                        needs.append(np.full(len(own), need, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(needs))], names=["signature", "set_key", "need"])
            trim()

        return self.docs.select("text").mapInArrow(each, "signature long, set_key long, need int")

    def contents(self, facts: DataFrame, wanted: DataFrame) -> DataFrame:
        """set_key, shingles of the wanted set_keys, from the documents of one id each."""
        s = self.settings
        one = facts.join(wanted, "set_key", "left_semi").select("set_key", "id_hash")

        # A bit for each leading part of an id's hash: eight bits an id that is wanted, in pieces of 4 KB.
        bits = min(max(16, (8 * one.count()).bit_length()), s.id_bits)
        x = F.expr(f"shiftrightunsigned(id_hash, {64 - bits})")
        pieces = one.select(F.shiftright(x, 15).alias("piece"), x.bitwiseAND(32767).alias("bit")).groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("map")).collect()
        wanted_bits = np.zeros(1 << (bits - 3), np.uint8)
        for r in pieces:
            wanted_bits[r.piece << 12 : (r.piece + 1) << 12] = np.frombuffer(r.map, np.uint8)
        here = self.spark.sparkContext.broadcast(wanted_bits)  # 16 MB at most

        def there(batch: pa.RecordBatch) -> np.ndarray:
            x = batch.column("id_hash").to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            return (here.value[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 == 1

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()
            known: set[int] = set()
            for part in runs(b.filter(pa.array(there(b))) for b in batches):
                keys, values = [], []
                for x in text_sets(part, s.words):
                    key = set_key(x)
                    if key not in known:
                        known.add(key)
                        keys.append(key)
                        values.append(x.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.list_(pa.int64()))], names=["set_key", "shingles"])
            trim()

        found = self.docs.select("id_hash", "text").mapInArrow(each, "set_key long, shingles array<long>")
        return found.join(one.select("set_key"), "set_key", "left_semi").groupBy("set_key").agg(F.min_by("shingles", F.size("shingles")).alias("shingles"))

    def possible(self, pairs: DataFrame, facts: DataFrame) -> DataFrame:
        """The pairs (a, b) that sizes and parity maps allow; facts: set_key, n, parity."""
        p = pairs
        for k in "ab":
            p = p.join(facts.select(F.col("set_key").alias(k), F.col("n").alias(f"_n{k}"), F.col("parity").alias(f"_p{k}")), k)
        least, both = self.settings.least, F.col("_na") + F.col("_nb")
        apart = F.aggregate(F.zip_with("_pa", "_pb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        like = (100 * F.col("_na") >= least * F.col("_nb")) & (100 * F.col("_nb") >= least * F.col("_na"))
        # shared >= least (na + nb) / (100 + least), and the sets differ in na + nb - 2 shared.
        return p.filter(like & (apart * (100 + least) <= both * (100 - least))).select("a", "b")

    def piled(self, members: DataFrame, tile: int, rows: int) -> DataFrame:
        """`members` once for each pair of tiles with their own, and the pile that the pair of tiles is in."""
        tiles = members.groupBy("signature").agg(F.count(F.lit(1)).alias("sets")).withColumn("tiles", F.ceil(F.col("sets") / tile).cast("int"))
        tiles = self.scratch.save(tiles, "tiles")
        sent = tiles.agg(F.sum(F.col("sets") * F.col("tiles"))).first()[0] or 0
        m = members.join(tiles.drop("sets"), "signature").withColumn("own", F.pmod(F.xxhash64("set_key"), F.col("tiles")).cast("int"))
        m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        m = m.select("signature", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "set_key", "component", "n", "parity")
        return m.withColumn("pile", F.pmod(F.xxhash64("signature", "i", "j"), F.lit(sent // rows + 1)))

    def apart(self, members: DataFrame, tile: int = 1024, rows: int = 8192) -> DataFrame:
        """Distinct pairs (a < b) that share a signature, are of different components, and that sizes and parity maps allow.

        `members` (a table): signature, set_key, component, n, parity. A signature's sets are cut
        into tiles, and each of its rows goes to every pair of tiles with its own; these pairs, of
        whatever signatures, share piles of about `rows` rows, of which there are so many as the
        rows that were sent (not the sets) ask for. Only pairs that may link leave them.
        """
        least = self.settings.least

        def pairs(group: pa.Table) -> pa.Table:
            sig, i, j, own, keys, of, n = (group.column(c).to_numpy() for c in ("signature", "i", "j", "own", "set_key", "component", "n"))
            maps = group.column("parity").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(keys), -1)
            order = np.lexsort((j, i, sig))
            change = (np.diff(sig[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)
            a, b = [], []
            for part in np.split(order, np.flatnonzero(change) + 1):
                first = part[0]
                left, right = part[own[part] == i[first]], part[own[part] == j[first]]
                for s in range(0, len(left), 64):
                    x = left[s : s + 64]
                    nx, ny = n[x][:, None], n[right][None]
                    may = (of[x][:, None] != of[right][None]) & (100 * nx >= least * ny) & (100 * ny >= least * nx)
                    if i[first] == j[first]:
                        may &= keys[x][:, None] < keys[right][None]
                    p, q = may.nonzero()
                    if not len(p):
                        continue
                    p, q = x[p], right[q]
                    differ = np.bitwise_count(maps[p] ^ maps[q]).sum(axis=1, dtype=np.int64)
                    ok = differ * (100 + least) <= (n[p] + n[q]) * (100 - least)
                    a.append(np.minimum(keys[p[ok]], keys[q[ok]]))
                    b.append(np.maximum(keys[p[ok]], keys[q[ok]]))
            return pa.table({"a": np.concatenate([*a, np.zeros(0, np.int64)]), "b": np.concatenate([*b, np.zeros(0, np.int64)])})

        return self.piled(members, tile, rows).groupBy("pile").applyInArrow(pairs, "a long, b long").distinct()

    def verified(self, pairs: DataFrame, facts: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) whose Jaccard similarity reaches the threshold."""
        ends = pairs.select(F.col("a").alias("set_key")).unionByName(pairs.select(F.col("b").alias("set_key"))).distinct()
        held = self.scratch.save(self.contents(facts, ends), f"{name}-sets")
        both = pairs.join(held.select(F.col("set_key").alias("a"), F.col("shingles").alias("_x")), "a").join(held.select(F.col("set_key").alias("b"), F.col("shingles").alias("_y")), "b")
        shared = F.size(F.array_intersect("_x", "_y"))
        good = both.filter(100 * shared >= self.settings.least * (F.size("_x") + F.size("_y") - shared)).select("a", "b")
        good = self.scratch.save(good, f"{name}-links")
        self.scratch.drop(f"{name}-sets")
        return good

    def run(self) -> DataFrame:
        """doc_id, n (null text: 0), set_key, group (a set_key: that of the smallest set linked; null for empty sets)."""
        scratch, least = self.scratch, self.settings.least
        sets = self.read()
        # What is counted by a key becomes a table before it is joined back: both sides of the join are
        # then plain shuffles, which can be split where a third of all sets have one signature.
        posted = scratch.save(self.postings(), "postings")
        twice = posted.groupBy("signature").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).filter("low <> high").select("signature")
        live = scratch.save(posted.join(scratch.save(twice, "twice"), "signature"), "often")
        live = scratch.save(live.distinct(), "shared")
        scratch.drop("postings", "often")
        able = live.groupBy("set_key").agg(F.count(F.lit(1)).alias("have"), F.max("need").alias("need")).filter("have >= need").select("set_key", "have")
        live = scratch.save(live.join(able, "set_key").select("signature", "set_key", "have"), "able")
        # The set that shares most is the least changed of its copies: the others are compared with it.
        rank = F.struct((-F.col("have")).alias("less"), "set_key")
        best = live.groupBy("signature").agg(F.min(rank).alias("best"), F.max(rank).alias("worst")).filter("best <> worst").select("signature", F.col("best.set_key").alias("first"))
        live = live.join(scratch.save(best, "best"), "signature")
        live = scratch.save(live.select("signature", "set_key", "first"), "live")
        scratch.drop("twice", "shared", "able", "best")
        facts = scratch.save(sets.groupBy("set_key").agg(F.max("n").alias("n"), F.min("parity").alias("parity"), F.min("id_hash").alias("id_hash")), "facts")
        stars = live.filter("set_key <> first").select(F.least("first", "set_key").alias("a"), F.greatest("first", "set_key").alias("b")).distinct()
        stars = scratch.save(stars, "stars")
        links = self.verified(scratch.save(self.possible(stars, facts), "near"), facts, "star")
        of = scratch.save(components(links, scratch, "star-cc"), "star-of")
        placed = live.select("signature", "set_key").join(of.withColumnRenamed("node", "set_key"), "set_key", "left").select("signature", "set_key", F.coalesce("component", "set_key").alias("component"))
        placed = scratch.save(placed, "placed")
        # Two sets of a signature have met as centre and other; of three, two may not have.
        torn = placed.groupBy("signature").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("sets")).filter("low <> high and sets > 2").select("signature")
        left = scratch.save(placed.join(scratch.save(torn, "torn"), "signature", "left_semi").join(facts.drop("id_hash"), "set_key"), "left")
        more = self.apart(left).join(stars, ["a", "b"], "left_anti")
        more = scratch.save(more, "more")
        scratch.drop("live", "placed", "torn", "left", "tiles")
        if not more.isEmpty():
            both = links.unionByName(self.verified(more, facts, "rest"))
            of = scratch.save(components(both, scratch, "rest-cc"), "rest-of")
        out = sets.join(of.withColumnRenamed("node", "set_key"), "set_key", "left")
        out = out.select("doc_id", "n", "set_key", F.when(F.col("n") > 0, F.coalesce("component", "set_key")).alias("group"))
        out = scratch.save(out, "decided")
        scratch.drop("read", "facts", "near", "stars", "star-links", "star-of", "more", "rest-links", "rest-of")
        return out


def jaccard_components(spark: SparkSession, docs: DataFrame, scratch: Scratch, settings: Settings = Settings()) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (smallest doc_id linked to it, itself included).

    Null text, or one without words: no shingles, linked with nothing. Null doc_id: kept; the
    component's smallest id if any has one, else null. Repeated rows: a row each, linked with each
    other. Empty table: no rows. Very long texts: whole. Other columns are not read.
    """
    d = Join(spark, docs, scratch, settings).run()
    # A table of its own: the join's sides are then plain shuffles, which can be split at a hot group.
    first = scratch.save(d.filter(F.col("group").isNotNull()).groupBy("group").agg(F.min("doc_id").alias("first")), "first")
    d = d.join(first, "group", "left")
    return d.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("group").isNotNull(), F.col("first")).otherwise(F.col("doc_id")).alias("component_id"))


#: Losers of up to this many rows (counted) are broadcast; more are shuffled.
BROADCAST_ROWS = 500_000


def keep_one(spark: SparkSession, docs: DataFrame, scratch: Scratch, settings: Settings = Settings()) -> DataFrame:
    """`docs` with one document of each component, that of the smallest doc_id (null last); empty texts stay.

    Where a doc_id is repeated or null, rows are told apart by their sets; of equal ones one stays.
    """
    d = Join(spark, docs, scratch, settings).run()
    named = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "set_key")
    first = scratch.save(d.filter("n > 0").groupBy("group").agg(F.min(named).alias("first")), "first")
    d = d.join(first, "group", "left").withColumn("stays", (F.col("n") == 0) | F.col("first").eqNullSafe(named))
    d = scratch.save(d.select("doc_id", "n", "set_key", "stays"), "stays")
    repeated = d.groupBy("doc_id").count().filter("count > 1 or doc_id is null").select("doc_id")
    goes = scratch.save(d.filter("not stays").select("doc_id").unionByName(repeated).distinct(), "goes")
    few = goes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    side = F.broadcast if few else lambda x: x
    plain = docs.join(side(goes.select(F.col("doc_id").alias("_gone"))), F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti")
    repeated = scratch.save(repeated, "repeated")
    if repeated.isEmpty():
        return plain
    odd = docs.join(repeated.select(F.col("doc_id").alias("_odd")), F.col("doc_id").eqNullSafe(F.col("_odd")), "left_semi")
    schema = StructType([*odd.schema.fields, StructField("_key", LongType())])

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches):
            keys = pa.array([set_key(x) for x in text_sets(part, settings.words)], pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns, keys], names=[*part.schema.names, "_key"])

    keyed = odd.mapInArrow(key, schema)
    won = d.filter("stays and n > 0").select(F.col("doc_id").alias("_i"), F.col("set_key").alias("_k")).distinct()
    empty = d.filter("n = 0").select(F.col("set_key").alias("_k")).distinct()
    full = keyed.join(won, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_k")), "left_semi").dropDuplicates(["doc_id", "_key"])
    return plain.unionByName(full.drop("_key")).unionByName(keyed.join(empty, F.col("_key") == F.col("_k"), "left_semi").drop("_key"))


#: jaccard_components over the documents table in DuckDB's SQL.
JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, CAST(len(w) - 1 AS BIGINT)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other)
SELECT r.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.other) AS component_id
FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
