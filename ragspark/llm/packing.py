"""Lexical retrieval packing: seeds fill their windows with the unused neighbours that BM25 finds."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import CACHES, arrow_out, release, runs, small_batches, text_column, trim, words_of
from .word_bpe import WordBpe

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Bytes of words' hashes and ids that a worker remembers, at most.
CACHE = 160 << 20
#: Words tokenized in one text, parted by a special token.
JOINED = 2000
#: Bytes of text encoded at once.
ENCODED = 8 << 20
#: A term that so many documents, or fewer, have one of is a row of weights in an index.
DENSE = 8
#: Bytes of the table that a partition of the shuffle is to hold, and the most partitions.
ROUTED, MOST = 32 << 20, 100_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@dataclass
class Settings:
    """window: ids a sequence; end: the id after each document; shard: ids that one index covers;
    terms: of a seed, how many of its most telling terms are looked up (None: all); k1, b: of BM25."""

    window: int = 2048
    end: int = 1
    shard: int = 1_000_000
    terms: int | None = None
    k1: float = 1.2
    b: float = 0.75


class Known:
    """Words' ids by the words' 64-bit hashes: sorted keys, and where each one's ids are in `flat`."""

    def __init__(self, kind: np.dtype):
        self.keys, self.begin, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, kind)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes, and which are there."""
        if not len(self.keys):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return at, self.keys[at] == hashes

    def add(self, hashes: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """New words, each once."""
        order = np.argsort(hashes, kind="stable")
        at = np.searchsorted(self.keys, hashes[order])
        begin = len(self.flat) + np.cumsum(sizes) - sizes
        self.keys, self.begin, self.size = (np.insert(x, at, new[order]) for x, new in ((self.keys, hashes), (self.begin, begin), (self.size, sizes)))
        self.flat = np.concatenate([self.flat, ids])

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each has, and all of them, one after the other."""
        sizes = self.size[at].astype(np.int64)
        upto = np.cumsum(sizes)
        return sizes, self.flat[np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(self.begin[at] - (upto - sizes), sizes)]

    @property
    def bytes(self) -> int:
        return self.keys.nbytes + self.begin.nbytes + self.size.nbytes + self.flat.nbytes


class Encoder:
    """Ids of texts through ids of words: the tokenizer drops white space and merges nothing across it.

    New words of plain letters go through WordBpe if the vocabulary is one for it, others are
    tokenized many at once, a special token between them, which the tokenizer parts texts at before
    all else (one by one if it has none). Words that hold `<|` get no ids here, since
    the special tokens' names are matched before lower-casing: texts with them are tokenized by
    themselves. What is remembered is bounded by bytes: when `recent` holds half of them it becomes
    `older`, whose words are forgotten unless they are met again meanwhile.
    """

    def __init__(self, path: str, most: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.kind = np.dtype(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        named = sorted((i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and t.content.startswith("<|") and not (t.lstrip or t.rstrip or t.single_word or t.normalized))
        self.mark = named[-1] if named else None
        self.letters = WordBpe.of(path)
        self.recent, self.older = Known(self.kind), Known(self.kind)

    def tokenized(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all of them."""
        if self.letters is None:
            return self.by_tokenizer(words)
        out = self.letters.tokenized(words, lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids)
        rest = [i for i, x in enumerate(out) if x is None]
        sizes, ids = self.by_tokenizer([words[i] for i in rest])
        ids, at = ids.tolist(), 0
        for i, n in zip(rest, sizes.tolist(), strict=True):
            out[i] = ids[at : at + n]
            at += n
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        return sizes, np.fromiter(chain.from_iterable(out), self.kind, int(sizes.sum()))

    def by_tokenizer(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same by the tokenizer itself."""
        if self.mark is None:
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            return np.asarray([len(x) for x in lists], np.int64), np.asarray([i for x in lists for i in x], self.kind)
        mark, name = self.mark
        plain = ["" if "<|" in w else w for w in words]
        found = [np.zeros(0, self.kind)]
        for s in range(0, len(plain), JOINED):
            part = plain[s : s + JOINED]
            found.append(np.asarray(self.tokenizer.encode_batch_fast([name.join(part) + name], add_special_tokens=False)[0].ids, self.kind))
        ids = np.concatenate(found)
        ends = np.flatnonzero(ids == mark)
        return np.diff(ends, prepend=-1) - 1, ids[ids != mark]

    def words(self, words: list[str], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of the distinct words has, and all of them."""
        at = self.places(words, hashes)
        return self.recent.ids(at)

    def places(self, words: list[str], hashes: np.ndarray) -> np.ndarray:
        """Where `recent` has each of the distinct words, tokenized if they are new."""
        if self.recent.bytes > self.most // 2:
            self.older, self.recent = self.recent, Known(self.kind)
        _, there = self.recent.find(hashes)
        missing = np.flatnonzero(~there)
        at, there = self.older.find(hashes[missing])
        if there.any():
            self.recent.add(hashes[missing[there]], *self.older.ids(at[there]))
        new = missing[~there]
        if len(new):
            self.recent.add(hashes[new], *self.tokenized([words[i] for i in new]))
        return self.recent.find(hashes)[0]


def encode(texts: pa.Array, encoder: Encoder) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each text its ids (16 bits, or 32 if the vocabulary is larger), and its words' hashes, each as often as the word, as index terms."""
    special = pc.fill_null(pc.match_substring(texts, "<|"), False).to_pylist()
    words, codes, ends = words_of(texts)
    listed = words.to_numpy(zero_copy_only=False).tolist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, listed), np.uint64, len(listed))
    at = encoder.places(listed, hashes)
    sizes, begin, flat = encoder.recent.size[at].astype(np.int64), encoder.recent.begin[at], encoder.recent.flat
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    counts = sizes[codes]
    upto = np.append(0, np.cumsum(counts))
    stream = flat[np.arange(int(upto[-1])) + np.repeat(begin[codes] - upto[:-1], counts)]
    out, terms = [], []
    for i in range(len(texts)):
        a, b = ends[i], ends[i + 1]
        if special[i]:
            out.append(np.asarray([x for w in re.split(r"[\x20\x09-\x0D]+", texts[i].as_py()) if w for x in encoder.tokenizer.encode(w, add_special_tokens=False).ids], encoder.kind))
        else:
            out.append(stream[upto[a] : upto[b]].copy())
        terms.append(short[codes[a:b]])
    return out, terms


class Index:
    """A BM25 inverted index over one shard's documents (term frequencies within a document's words)."""

    def __init__(self, terms: list[np.ndarray], lengths: np.ndarray, settings: Settings):
        n = len(terms)
        all_terms = np.concatenate([*terms, np.zeros(0, np.uint32)])
        owner = np.repeat(np.arange(n, dtype=np.int32), [len(t) for t in terms])
        order = np.argsort(all_terms, kind="stable")
        t, d = all_terms[order], owner[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (d[1:] != d[:-1])
        at = np.flatnonzero(new)
        self.docs, tf = d[at], np.diff(np.append(at, len(t)))
        _, self.begin, self.df = np.unique(t[at], return_index=True, return_counts=True)
        place = np.repeat(np.arange(len(self.df), dtype=np.int32), self.df)
        by_doc = np.argsort(self.docs, kind="stable")
        self.terms = np.split(place[by_doc], np.cumsum(np.bincount(self.docs, minlength=n))[:-1]) if n else []
        idf = np.log1p((n - self.df + 0.5) / (self.df + 0.5))
        mean = max(1.0, float(lengths.mean())) if n else 1.0
        norm = settings.k1 * (1 - settings.b + settings.b * lengths / mean)
        weight = idf[place] * tf * (settings.k1 + 1) / (tf + norm[self.docs])
        # What a DENSE-th of the documents have is a row of their weights, other terms are lists: both together are a few times the postings.
        often = self.df * DENSE >= max(n, 1)
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        self.dense, listed = np.zeros((int(often.sum()), n)), ~often[place]
        self.dense[self.row[place[~listed]], self.docs[~listed]] = weight[~listed]
        self.alive, self.most = np.arange(n), settings.terms
        self.end = self.begin + self.df
        self._keep(listed)
        self.weight = weight[listed]

    def _keep(self, live: np.ndarray) -> None:
        """Lists of these postings alone."""
        upto = np.append(0, np.cumsum(live))
        self.docs, self.begin, self.end = self.docs[live].astype(np.int64), upto[self.begin], upto[self.end]

    def shrink(self, unused: np.ndarray) -> None:
        """Used documents go from rows and lists: no seed gets them any more."""
        keep = unused[self.alive]
        live = keep[self.docs]
        self._keep(live)
        self.docs, self.weight = (np.cumsum(keep) - 1)[self.docs], self.weight[live]
        self.alive, self.dense = self.alive[keep], self.dense[:, keep]

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """The unused documents that share a queried term with the seed, best first (ties: as they came)."""
        if 8 * np.count_nonzero(unused) < 7 * len(self.alive):
            self.shrink(unused)
        t = self.terms[seed]
        t = t[self.df[t] > 1]
        if self.most is not None and len(t) > self.most:
            t = t[np.argsort(self.df[t], kind="stable")[: self.most]]
        if not len(t):
            return np.zeros(0, np.int64)
        rows = self.row[t]
        scores = self.dense[rows[rows >= 0]].sum(0)
        begin, sizes = self.begin[t], self.end[t] - self.begin[t]
        upto = np.cumsum(sizes)
        if upto[-1]:
            at = np.arange(upto[-1]) + np.repeat(begin - (upto - sizes), sizes)
            scores += np.bincount(self.docs[at], self.weight[at], len(self.alive))
        found = np.flatnonzero(unused[self.alive] & (scores > 0))
        return self.alive[found[np.argsort(-scores[found], kind="stable")]]


def pack(ids: list[np.ndarray], terms: list[np.ndarray], settings: Settings) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one shard; each id is in exactly one.

    The first unused document is a seed; it fills its window, then its neighbours do, best first,
    then (if they run out) the next unused documents. A document cut at a window's end goes on in
    the next, whose seed it is. What the last window holds is cut into powers of two, which need no
    padding.
    """
    lengths = np.asarray([len(x) for x in ids], np.int64)
    index, unused = Index(terms, lengths, settings), np.ones(len(ids), bool)
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence, at, upcoming, nearest, next_up = 0, 0, 0, np.zeros(0, np.int64), 0

    for _ in range(len(ids)):
        while next_up < len(nearest) and not unused[nearest[next_up]]:
            next_up += 1
        if at and next_up < len(nearest):
            doc = int(nearest[next_up])
        else:
            while not unused[upcoming]:
                upcoming += 1
            doc = upcoming
        unused[doc] = False
        start, n, crossed = 0, int(lengths[doc]), at == 0 or next_up >= len(nearest)
        while start < n:
            length = min(settings.window - at, n - start)
            pieces.append((doc, start, length, sequence, at))
            start, at = start + length, at + length
            if at == settings.window:
                sequence, at, crossed = sequence + 1, 0, True
        if crossed and at:
            nearest, next_up = index.neighbours(doc, unused), 0
    if at and at & (at - 1):
        return [p for p in pieces if p[3] != sequence] + _binary([p for p in pieces if p[3] == sequence], at, sequence)
    return pieces


def _binary(last: list[tuple[int, int, int, int, int]], total: int, sequence: int) -> list[tuple[int, int, int, int, int]]:
    """The last window's pieces cut into sequences as long as the powers of two that add up to it."""
    out, room, at = [], 1 << (total.bit_length() - 1), 0
    left = total
    for doc, start, length, _, _ in last:
        while length:
            n = min(length, room - at)
            out.append((doc, start, n, sequence, at))
            start, length, at, left = start + n, length - n, at + n, left - n
            if at == room:
                sequence, at = sequence + 1, 0
                room = 1 << (left.bit_length() - 1) if left else 0
    return out


def routed(terms: np.ndarray) -> int:
    """Where a document goes: the fullest of 256 buckets of its word hashes, and the least of them (no words: 0).

    Copies, near copies and many documents on one matter share it; the bucket parts languages and kinds.
    """
    if not len(terms):
        return 0
    return int(np.bincount((terms & 255).astype(np.int64), minlength=256).argmax()) << 32 | int(terms.min())


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """A row per document: doc_id, key (see `routed`), width (bytes an id), ids and terms as bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("terms", pa.binary())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        encoder = worker_encoder(path)
        for part in runs(batches, limit=ENCODED):
            ids, terms = encode(text_column(part), encoder)
            yield arrow_out(schema, {"doc_id": part.column("doc_id"), "key": [routed(t) for t in terms], "width": [encoder.kind.itemsize] * len(ids), "ids": [x.tobytes() for x in ids], "terms": [t.tobytes() for t in terms]})
        trim()

    return docs.select("doc_id", "text").mapInArrow(each, "doc_id long, key long, width int, ids binary, terms binary")


def partitions(docs: DataFrame) -> int:
    """Partitions for the shuffle of encoded documents: by the plan's estimate of its bytes, nothing is run for it."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max(size // ROUTED, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), MOST)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, settings: Settings = Settings()) -> DataFrame:
    """A row per piece of a document, in sequences of at most settings.window ids.

    Documents are tokenized once and their ids shuffled once, by `routed`, so that those with most
    words in common meet whatever files they came from; a key that many share is split (adaptive
    rebalancing). Each partition, in the order of the keys, packs its documents in shards of about
    settings.shard ids with an index each; sequence_id is the partition's number and the count in
    it. Null or empty text: the end id alone. Null doc_id: kept. Repeated rows: packed each. A text
    longer than a window is cut. Empty table: no rows. Other columns are not read. doc_tokens counts
    the end id.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
        release()
        first = TaskContext.get().partitionId() << 32
        names: list = []
        ids: list[np.ndarray] = []
        terms: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal first
            packed = pack(ids, terms, settings)
            out = {n: [] for n in schema.names}
            for doc, start, length, sequence, offset in packed:
                out["doc_id"].append(names[doc])
                out["start"].append(start)
                out["length"].append(length)
                out["ids_crc32"].append(zlib.crc32(ids[doc][start : start + length].astype("<u4").tobytes()))
                out["doc_tokens"].append(len(ids[doc]))
                out["sequence_id"].append(first + sequence)
                out["offset"].append(offset)
            first = max(out["sequence_id"]) + 1
            names.clear(), ids.clear(), terms.clear()
            return arrow_out(schema, out)

        held = 0
        for batch in batches:
            for name, width, x, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "width", "ids", "terms")), strict=True):
                kind = np.dtype(f"u{width}")
                names.append(name)
                ids.append(np.append(np.frombuffer(x, kind), kind.type(settings.end)))
                terms.append(np.frombuffer(t, np.uint32))
                held += len(ids[-1])
                if held >= settings.shard:
                    yield flush()
                    held = 0
        if names:
            yield flush()
        trim()

    small_batches(docs.sparkSession)
    spread = encoded(docs, tokenizer or default_tokenizer()).hint("rebalance", partitions(docs), "key")
    return spread.sortWithinPartitions("key", "doc_id", "ids").select("doc_id", "width", "ids", "terms").mapInArrow(each, SCHEMA)


_ENCODERS: dict[str, Encoder] = {}
CACHES.append(_ENCODERS)


def worker_encoder(path: str) -> Encoder:
    """The worker's encoder, kept between tasks (a worker serves many)."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
