"""Language-model scoring by a weighted backoff automaton over smoothed n-grams, counted from the whole corpus.

With c(.) the training counts, N all tokens, V distinct ones, h a history of words before w (the
text's begin counts as one) and h' the same without its first,

    p(w)     = (c(w) + 1) / (N + V + 1)              one share stays for words not seen
    p(w | h) = (c(h w) + mu p(w | h')) / (c(h) + mu)

which sums to 1 for every h. As an automaton: a state per n-gram shorter than the order, an arc per
seen n-gram h w with weight log p(w | h), which leads from h to h w (cut at its front to what can be a
state), and from each state h a failure arc to h' with the backoff weight log(mu / (c(h) + mu)). At the
root every word has an arc. A word is read by following failure arcs until there is an arc for it.

Counts grow with the corpus, so they are never gathered in one place. Documents are dealt into
chunks. A chunk sends its distinct n-grams, with their training counts, in 2**bits messages by the
leading bits of their hashes; of each such range, up to 2**bits chunks' messages are summed by one
task, which is then itself as a chunk: it sends its sums on, by the next bits, until one task has a
range of all chunks. The totals come back the same way, in the order of what was sent. So messages
have the same size and tasks the same work at any size of the corpus; only the number of levels grows,
by one a factor of 2**bits. A chunk builds the part of the automaton that its texts can reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_mod, hash_words, mix, release, text_column, words_of

#: Fixed hashes of the tokens that no text can hold.
END, START = np.uint64(0x454E44), np.uint64(0x5354415254)
#: The lowest bit of a hash: 0 for a token, 1 for a longer n-gram and for the text's begin.
LONGER = np.uint64(1)
ROOT = -1
#: Repeated rows up to this many keys (counted) are broadcast; more are shuffled.
BROADCAST_ROWS = 500_000
#: Partitions that chunks are dealt to, at most.
PARTITIONS = 100_000


@dataclass
class Settings:
    """order: words of the longest n-gram; prior: mu; chunk: bytes of text a chunk, on average;
    bits: see above; piece: tokens that are walked one after the other (longer texts in pieces)."""

    order: int = 2
    prior: float = 256.0
    chunk: int = 4_000_000
    bits: int = 10
    piece: int = 256
    fold: int = 7
    held_out: int = 2


@dataclass
class Chunk:
    """grams: the distinct n-grams' hashes, sorted; counts: in training texts; begin: the place of the
    text's begin; at[k - 1, i]: the place of the n-gram of k tokens that ends at token i (or -1);
    ends: where texts end among the tokens."""

    grams: np.ndarray
    counts: np.ndarray
    begin: int
    at: np.ndarray
    ends: np.ndarray


def chunk_of(texts: pa.Array, times: np.ndarray, order: int) -> Chunk:
    """Tokens of a chunk: each text's words, then one end; `times`: how often a text counts in training."""
    words, codes, cut = words_of(texts)
    n = len(texts)
    hashes = np.append(hash_words(words), END) & ~LONGER
    ends = cut + np.arange(n + 1)
    inner = np.ones(len(codes) + n, bool)
    inner[ends[1:] - 1] = False
    tokens = np.full(len(inner), len(words), np.int64)
    tokens[inner] = codes
    sizes = np.diff(ends)
    place = np.arange(len(tokens)) - np.repeat(ends[:-1], sizes)
    weight = np.repeat(times, sizes)
    own = hashes[tokens]
    keys, where = [own], [np.arange(len(tokens))]
    for k in range(2, order + 1):
        before = np.empty_like(own)
        before[1:] = keys[-1][:-1]
        if k == 2:
            before[ends[:-1]] = START | LONGER
        keys.append(mix(mix(before) * np.uint64(0x9E3779B97F4A7C15) + own) | LONGER)
        where.append(np.flatnonzero(place >= k - 2))
    grams, found = np.unique(np.concatenate([*(x[i] for x, i in zip(keys, where, strict=True)), [START | LONGER]]), return_inverse=True)
    counts = np.bincount(found, np.concatenate([*(weight[i] for i in where), [times.sum()]]), len(grams)).astype(np.int64)
    at = np.full((order, len(tokens)), -1, np.int32)
    for row, i, got in zip(at, where, np.split(found, np.cumsum([len(i) for i in where])), strict=False):
        row[i] = got
    return Chunk(grams, counts, int(found[-1]), at, ends)


class Automaton:
    """The part of the model that a chunk's texts can reach; states and arcs are places among its n-grams, ROOT the empty history.

    length: of a state's history; backoff, fail: its failure arc; an arc of n-gram g exists if
    seen[g], with weight[g], and leads to goal[g]. The arrays' last entry is the root's.
    """

    def __init__(self, chunk: Chunk, totals: np.ndarray, n_all: int, v_all: int, settings: Settings):
        size, mu = len(chunk.grams), settings.prior
        self.chunk, self.settings = chunk, settings
        self.length, self.fail, history = np.zeros(size + 1, np.int64), np.full(size + 1, ROOT), np.full(size + 1, ROOT)
        first = np.zeros(chunk.at.shape[1], bool)
        first[chunk.ends[:-1]] = True
        p = np.ones(size + 1)
        counted = np.append(totals, 0)
        for k in range(1, settings.order + 1):
            at = np.flatnonzero(chunk.at[k - 1] >= 0)
            g, one = np.unique(chunk.at[k - 1, at], return_index=True)
            at = at[one]
            self.length[g] = k
            if k == 1:
                p[g] = (counted[g] + 1) / (n_all + v_all + 1)
                continue
            self.fail[g] = chunk.at[k - 2, at]
            history[g] = np.where(first[at], chunk.begin, chunk.at[k - 2, at - 1])
            p[g] = (counted[g] + mu * p[self.fail[g]]) / (counted[history[g]] + mu)
        self.length[chunk.begin] = 1
        self.weight, self.backoff = np.log10(p), np.log10(mu / (counted + mu))
        self.backoff[ROOT] = 0.0
        self.seen = (counted > 0) | (self.length == 1)
        self.goal = np.where(self.length < settings.order, np.arange(size + 1), self.fail)

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states and the weights on the way: failure arcs until there is an arc for the token, then that."""
        state, weight, arc = state.copy(), np.zeros(len(state)), np.empty(len(state), np.int64)
        left = np.arange(len(state))
        while len(left):
            g = self.chunk.at[self.length[state[left]], token[left]]
            there = self.seen[g]
            arc[left[there]] = g[there]
            left = left[~there]
            weight[left] += self.backoff[state[left]]
            state[left] = self.fail[state[left]]
        return self.goal[arc], weight + self.weight[arc]

    def walk(self) -> np.ndarray:
        """log10 p of each text: one traversal from left to right, all texts of the chunk side by side.

        A long text goes in pieces; each begins in the state that the words before it lead to, which
        are order - 1 at most.
        """
        ends, piece, context = self.chunk.ends, max(self.settings.piece, self.settings.order), self.settings.order - 1
        pieces = -(-np.diff(ends) // piece)
        owner = np.repeat(np.arange(len(pieces)), pieces)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = ends[owner] + number * piece
        length = np.minimum(ends[owner + 1] - start, piece)
        longest = np.argsort(-length, kind="stable")
        owner, number, start, length = owner[longest], number[longest], start[longest], length[longest]
        state = np.where(number == 0, self.chunk.begin if context else ROOT, ROOT)
        later = np.flatnonzero(number > 0)
        for back in range(context, 0, -1):
            state[later], _ = self.step(state[later], start[later] - back)
        total = np.zeros(len(owner))
        for t in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -t))  # pieces longer than t
            state[:n], weight = self.step(state[:n], start[:n] + t)
            total[:n] += weight
        return np.bincount(owner, total, len(pieces))


def pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as differences, byte by byte of all: upper bytes are zeros and compress away."""
    return pack_counts(np.diff(values, prepend=np.uint64(0)))


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_counts(data).view(np.uint64), dtype=np.uint64)


def pack_counts(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()


SENT = "prefix long, up long, node long, grams binary, counts binary"
TOLD = "prefix long, node long, answer binary, n long, v long"


def messages(prefix: int, node: int, level: int, grams: np.ndarray, counts: np.ndarray, bits: int) -> pa.Table:
    """SENT rows of a node at a level (a chunk at 0) whose n-grams have the leading bits `prefix`: one per next bits that occur."""
    next_bits = (grams >> np.uint64(64 - bits * (level + 1))) & np.uint64((1 << bits) - 1)
    begin = np.flatnonzero(np.diff(next_bits, prepend=np.uint64(1 << bits)))
    end = np.append(begin[1:], len(grams))
    n = len(begin)
    return pa.table(
        [pa.array([(prefix << bits) | int(b) for b in next_bits[begin]], pa.int64()), pa.array([node >> bits] * n, pa.int64()), pa.array([node] * n, pa.int64())]
        + [pa.array([f(x[a:b]) for a, b in zip(begin, end, strict=True)], pa.binary()) for f, x in ((pack, grams), (pack_counts, counts))],
        names=["prefix", "up", "node", "grams", "counts"],
    )


def summed(group: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of the messages of a range: its distinct n-grams, their sums, and where each message's are among them."""
    lists = [unpack(x) for x in group.column("grams").to_pylist()]
    grams, at = np.unique(np.concatenate(lists), return_inverse=True)
    counts = np.bincount(at, np.concatenate([unpack_counts(x) for x in group.column("counts").to_pylist()]), len(grams)).astype(np.int64)
    return grams, counts, np.split(at, np.cumsum([len(x) for x in lists])[:-1])


def answers(group: pa.Table, totals: np.ndarray, at: list[np.ndarray], n: int = 0, v: int = 0) -> pa.Table:
    """TOLD rows for the messages of a range; n and v on the first."""
    rest = [0] * (group.num_rows - 1)
    return pa.table(
        [group.column("prefix"), group.column("node"), pa.array([pack_counts(totals[i]) for i in at], pa.binary()), pa.array([n, *rest], pa.int64()), pa.array([v, *rest], pa.int64())],
        names=["prefix", "node", "answer", "n", "v"],
    )


def in_order(told: pa.Table) -> np.ndarray:
    """What came back to a node, in the order of its n-grams."""
    return np.concatenate([unpack_counts(x) for x in told.sort_by("prefix").column("answer").to_pylist()])


def totals_of(sent: DataFrame, chunks: int, scratch: Scratch, bits: int) -> DataFrame:
    """TOLD rows for what the chunks sent (SENT), with the sums over all of them."""

    def top(group: pa.Table) -> pa.Table:
        grams, counts, at = summed(group)
        token = (grams & LONGER) == 0
        return answers(group, counts, at, int(counts[token].sum()), int((counts[token] > 0).sum()))

    def onward(level: int):
        def add(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
            grams, counts, _ = summed(group)
            return messages(key[0].as_py(), key[1].as_py(), level, grams, counts, bits)

        return add

    def tell(group: pa.Table, told: pa.Table) -> pa.Table:
        _, _, at = summed(group)
        return answers(group, in_order(told), at)

    kept, level = [], 1
    while 1 << (bits * level) < chunks:
        kept.append(scratch.save(sent, f"sent{level}"))
        sent = kept[-1].groupBy("prefix", "up").applyInArrow(onward(level), SENT)
        level += 1
    told = scratch.save(sent.groupBy("prefix", "up").applyInArrow(top, TOLD), f"told{level}")
    for sent in reversed(kept):
        counted = told.select("n", "v").filter("n > 0 or v > 0")
        back = told.filter("node is not null").select("prefix", "node", "answer").withColumn("_p", F.shiftright("prefix", bits))
        back = sent.groupBy("prefix", "up").cogroup(back.groupBy("_p", "node")).applyInArrow(tell, TOLD)
        level -= 1
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (("prefix", "long"), ("node", "long"), ("answer", "binary"))]
        told = scratch.save(back.unionByName(counted.select(*nothing, "n", "v")), f"told{level}")
        scratch.drop(f"sent{level}", f"told{level + 1}")
    return told


def score(docs: DataFrame, scratch: Scratch, settings: Settings = Settings()) -> DataFrame:
    """A row per document: its token counts, the unigram base score and the automaton's log10 probability.

    Null or empty text: the end alone. Null doc_id: the fold of the empty text, in training.
    Repeated rows: each counts in training and has a row; rows equal in doc_id and text are counted
    first and scored once, however many they are. No training rows: N = V = 0. Empty table: no rows.
    Very long texts are whole in one chunk. Other columns are not read.
    """
    held_out, bits = settings.held_out, settings.bits
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), crc_mod("doc_id", settings.fold).alias("rest")).withColumn("key", F.xxhash64("doc_id", "text"))
    keys = scratch.save(d.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")), "keys")
    chars = keys.agg(F.sum("bytes")).first()[0] or 0
    again = scratch.save(keys.filter("n > 1").select("key"), "again")
    repeated = again.limit(BROADCAST_ROWS + 1).count()
    if repeated:
        side = F.broadcast(again) if repeated <= BROADCAST_ROWS else again
        many = d.join(side, "key", "left_semi").groupBy("doc_id", "text", "rest", "key").agg(F.count(F.lit(1)).alias("times"))
        d = d.join(side, "key", "left_anti").withColumn("times", F.lit(1).cast("long")).unionByName(many)
    else:
        d = d.withColumn("times", F.lit(1).cast("long"))
    chunks = int(chars // settings.chunk) + 1
    parts = min(chunks, PARTITIONS)  # of about a chunk each, whatever the session's number is
    dealt = d.withColumn("chunk", F.pmod("key", F.lit(chunks)).cast("long")).drop("key").repartition(parts, "chunk")

    def read(group: pa.Table) -> tuple[pa.Table, Chunk]:
        release()
        group = group.combine_chunks()
        times = group.column("times").to_numpy() * (group.column("rest").to_numpy() != held_out)
        return group, chunk_of(text_column(group.to_batches()[0]), times, settings.order)

    def send(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        _, c = read(group)
        return messages(0, key[0].as_py(), 0, c.grams, c.counts, bits)

    told = totals_of(dealt.groupBy("chunk").applyInArrow(send, SENT), chunks, scratch, bits)
    totals = told.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    n_all, v_all = int(totals.n), int(totals.v)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("times", pa.int64())])

    def walk(group: pa.Table, told: pa.Table) -> Iterator[pa.Table] | pa.Table:
        if not group.num_rows:
            return schema.empty_table()
        group, c = read(group)
        counts = in_order(told)
        tokens, sizes = c.at[0], np.diff(c.ends)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        base = np.log10((counts + 1) / (n_all + v_all + 1))
        automaton = Automaton(c, counts, n_all, v_all, settings)
        return pa.table(
            {
                "doc_id": group.column("doc_id"),
                "held_out": pa.array(group.column("rest").to_numpy() == held_out),
                "n_tokens": pa.array(sizes),
                "n_known": pa.array(np.bincount(owner, counts[tokens] > 0, len(sizes)).astype(np.int64)),
                "train_tokens": pa.array(np.full(len(sizes), n_all)),
                "base_score": pa.array(np.bincount(owner, base[tokens], len(sizes))),
                "score": pa.array(automaton.walk()),
                "times": group.column("times"),
            },
            schema=schema,
        )

    told = told.filter("node is not null").select("prefix", "answer", F.col("node").alias("chunk")).repartition(parts, "chunk")
    out = dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(walk, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, times long")
    if repeated:
        out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("_copy")
    return out.drop("times")
