"""Cross-tokenizer alignment: one sweep over two tokenizers' end events, counts of linked ids over the corpus, then sums by document."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHES, Scratch, arrow_out, release, runs, text_column, trim
from .packing import Encoder, Known
from .word_bpe import byte_letters

#: Bytes of words and ids that a worker remembers a side, bytes of text encoded at once, words tokenized in one text.
CACHE, ENCODED, JOINED = 64 << 20, 4 << 20, 2000
#: Ids of a row of events, and ids that the sweep holds before it works on them.
RUN, HELD = 1 << 15, 1 << 19
#: Stands for a word whose tokens do not spell it; no id of the vocabularies.
LOSSY = 65535
#: Words longer than this, or with letters beyond Latin, are tokenized by themselves by the tokenizer's own engine.
LONG, LATIN = 200, re.compile("[^\0-ɏ]")


@dataclass
class Settings:
    """Paths of the two vocabularies: a byte-level BPE (tokenizers' JSON) and a piece model (sentencepiece)."""

    byte_level: str = ""
    pieces: str = ""

    def __post_init__(self):
        if not (self.byte_level and self.pieces):
            import public_tokenizers

            self.byte_level = self.byte_level or public_tokenizers.path("byte_bpe_50k.json")
            self.pieces = self.pieces or public_tokenizers.path("piece_bpe_32k.model")


class Entries:
    """The bytes of a vocabulary's ids: all of them in `flat`, from begin[id] on, sizes[id] long."""

    def __init__(self, entries: list[bytes]):
        self.sizes = np.asarray([len(e) for e in entries], np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(entries), np.uint8)
        if not self.sizes.all() or len(entries) > LOSSY:
            raise ValueError("each id needs bytes, and ids need 16 bits")

    def spelt(self, ids: np.ndarray) -> np.ndarray:
        n = self.sizes[ids]
        upto = np.cumsum(n)
        return self.flat[np.arange(int(upto[-1]) if len(n) else 0) + np.repeat(self.begin[ids] - (upto - n), n)]


class Side(Encoder):
    """Ids of words, each with a space before it, remembered by the words' hashes (see Encoder)."""

    entries: Entries

    def __init__(self, entries: list[bytes], most: int):
        self.entries, self.most, self.kind = Entries(entries), most, np.dtype(np.uint16)
        self.recent, self.older = Known(self.kind), Known(self.kind)

    def joined(self, text: str) -> list[int]:
        """Ids of a space and the text, as fast as may be; used for Latin words of moderate length."""
        return self.encoded(text)

    def encoded(self, text: str) -> list[int]:
        """Ids of a space and the text."""
        raise NotImplementedError

    def alone(self, text: str) -> np.ndarray:
        """Ids of a space and the text, or LOSSY if they do not spell it."""
        ids = np.asarray(self.encoded(text), self.kind)
        return ids if self.entries.spelt(ids).tobytes() == b" " + text.encode() else np.asarray([LOSSY], self.kind)

    def tokenized(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all of them.

        Words are tokenized many at once, a space before each: neither tokenizer merges across a space
        that follows something else. Ends of ids then fall on ends of words; where they do not, or do
        not spell them, each word goes by itself.
        """
        out: list[np.ndarray] = [None] * len(words)
        apart = [i for i, w in enumerate(words) if not w or w[-1].isspace() or w[0].isspace() or len(w) > LONG or LATIN.search(w)]
        for i in apart:
            out[i] = self.alone(words[i])
        rest = [i for i in range(len(words)) if out[i] is None]
        for s in range(0, len(rest), JOINED):
            part = rest[s : s + JOINED]
            text = " ".join(words[i] for i in part)
            ids = np.asarray(self.joined(text), self.kind)
            ends = np.cumsum(self.entries.sizes[ids])
            want = np.cumsum([len(words[i].encode()) + 1 for i in part])
            at = np.searchsorted(ends, want)
            if len(ends) and ends[-1] == want[-1] and (ends[at] == want).all() and self.entries.spelt(ids).tobytes() == b" " + text.encode():
                for i, x in zip(part, np.split(ids, at[:-1] + 1), strict=True):
                    out[i] = x
            else:
                for i in part:
                    out[i] = self.alone(words[i])
        return np.asarray([len(x) for x in out], np.int64), np.concatenate([np.zeros(0, self.kind), *out])


class ByteSide(Side):
    """Byte-level BPE. If ids follow the order of the merges, joined words go through the same merges in a faster engine."""

    def __init__(self, path: str, most: int = CACHE):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        letters, vocab = byte_letters(), self.tokenizer.get_vocab()
        spelt = [b""] * (max(vocab.values()) + 1)
        for word, i in vocab.items():
            spelt[i] = bytes(letters[c] for c in word)
        super().__init__(spelt, most)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in merges]
        self.fast = None
        if made == sorted(made) and len(made) + 256 == len(model["vocab"]) and min(made, default=256) >= 256:
            self.fast = tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks={spelt[i]: i for i in model["vocab"].values()}, special_tokens={})

    def joined(self, text: str) -> list[int]:
        return self.fast.encode_ordinary(" " + text) if self.fast else self.encoded(text)

    def encoded(self, text: str) -> list[int]:
        return self.tokenizer.encode(" " + text, add_special_tokens=False).ids


class PieceSide(Side):
    """Pieces with byte fallback; the model puts the space before the text."""

    def __init__(self, path: str, most: int = CACHE):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.is_byte = np.asarray([self.model.is_byte(i) for i in range(len(pieces))])
        super().__init__([bytes([int(p[3:5], 16)]) if b else p.replace("▁", " ").encode() for p, b in zip(pieces, self.is_byte, strict=True)], most)

    def encoded(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


@dataclass
class Pairs:
    """Numbers for the pairs of ids that can be linked at all.

    Of two tokens that end together one spells the other's end, so a pair is named by the longer
    token and the length of the shorter one (and, of a piece, whether it is a byte). That bounds
    their number by the vocabularies: `count`, below 10^6 for the given two, whatever the corpus.
    """

    a: Entries
    b: Entries
    is_byte: np.ndarray
    from_a: np.ndarray = field(init=False)
    from_b: np.ndarray = field(init=False)
    count: int = field(init=False)

    def __post_init__(self):
        spell = lambda e: [e.flat[s : s + n].tobytes() for s, n in zip(e.begin.tolist(), e.sizes.tolist(), strict=True)]
        if len(set(spell(self.a))) < len(self.a.sizes) or len(set(zip(spell(self.b), self.is_byte.tolist(), strict=True))) < len(self.b.sizes):
            raise ValueError("two ids of a vocabulary have the same bytes")
        self.from_a = np.cumsum(2 * self.a.sizes) - 2 * self.a.sizes
        self.from_b = np.cumsum(self.b.sizes) - self.b.sizes + 2 * int(self.a.sizes.sum())
        self.count = int(2 * self.a.sizes.sum() + self.b.sizes.sum())

    def code(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = self.a.sizes[a], self.b.sizes[b]
        return np.where(x >= y, self.from_a[a] + 2 * (y - 1) + self.is_byte[b], self.from_b[b] + x - 1)


class Tools:
    """A worker's two sides, the pairs' numbers, and ids as text: eight bytes each, the decimal id, what follows it, zeros."""

    def __init__(self, settings: Settings):
        self.a, self.b = ByteSide(settings.byte_level), PieceSide(settings.pieces)
        self.pairs = Pairs(self.a.entries, self.b.entries, self.b.is_byte)
        text = lambda n, mark: np.frombuffer(b"".join(f"{i}{mark}".encode().ljust(8, b"\0") for i in range(n)), np.uint64)
        n, m = len(self.a.entries.sizes), len(self.b.entries.sizes)
        self.a_text, self.a_last, self.b_text, self.b_last = text(n, ","), text(n, "|"), text(m, ","), text(m, ";")


def chunks(texts: pa.Array) -> pa.Array:
    """Each text's words: cut at spaces that follow something else than white space, without these."""
    plain = pc.invert(pc.match_substring_regex(texts, r"(^|[\s\x1c-\x1f\x85\p{Z}]) "))
    if pc.all(plain, min_count=0).as_py():
        return pc.split_pattern(texts, " ")
    lists = pc.split_pattern(texts, " ").to_pylist()
    for i in np.flatnonzero(~plain.to_numpy(zero_copy_only=False)):
        lists[i] = re.split(r"(?<=\S) ", texts[int(i)].as_py())
    return pa.array(lists, pa.list_(pa.string()))


def encode(texts: pa.Array, tools: Tools) -> list[tuple[np.ndarray, np.ndarray]]:
    """Both sides' ids of each text; none where it is null, empty or not what its tokens spell."""
    lists = chunks(pc.fill_null(texts, ""))
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    words = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    ends = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
    streams = []
    for side in (tools.a, tools.b):
        sizes, flat = side.words(words, hashes)
        begin, counts = np.cumsum(sizes) - sizes, sizes[codes]
        upto = np.append(0, np.cumsum(counts))
        ids = flat[np.arange(int(upto[-1])) + np.repeat(begin[codes] - upto[:-1], counts)]
        streams.append((ids, upto[ends], np.flatnonzero(ids == LOSSY)))
    none = (np.zeros(0, np.uint16),) * 2
    out = [tuple(ids[at[i] : at[i + 1]] for ids, at, _ in streams) for i in range(len(texts))]
    empty = pc.equal(pc.fill_null(texts, ""), "").to_numpy(zero_copy_only=False)
    for i in {int(i) for _, at, bad in streams for i in np.searchsorted(at, bad, "right") - 1 if not empty[i]}:
        whole = tuple(side.alone(texts[i].as_py()) for side in (tools.a, tools.b))
        out[i] = none if any(len(x) and x[0] == LOSSY for x in whole) else whole
    return [none if e else x for e, x in zip(empty, out, strict=True)]


EVENTS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("side", pa.int8()), ("ids", pa.binary())])


def end_events(docs: DataFrame, settings: Settings) -> DataFrame:
    """key, doc_id, at, side, ids: the end events of both sides, a run of them a row.

    An id's end is its run's `at` and the sizes of the ids up to it, so events travel as 16-bit ids.
    key numbers the documents by their place in the input; one without tokens has one empty run.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, key = worker_tools(settings), TaskContext.get().partitionId() << 40
        for part in runs(batches, limit=ENCODED):
            out: dict = {n: [] for n in EVENTS.names}
            for doc_id, sides in zip(part.column("doc_id").to_pylist(), encode(text_column(part), tools), strict=True):
                for side, (ids, entries) in enumerate(zip(sides, (tools.a.entries, tools.b.entries), strict=True)):
                    at = 0
                    for s in range(0, max(len(ids), 1 - side), RUN):
                        run = ids[s : s + RUN]
                        for n, v in zip(EVENTS.names, (key, doc_id, at, side, run.tobytes()), strict=True):
                            out[n].append(v)
                        at += int(entries.sizes[run].sum()) if len(ids) > s + RUN else 0
                key += 1
            if out["key"]:
                yield arrow_out(EVENTS, out)
        trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "key long, doc_id long, at long, side byte, ids binary")


@dataclass
class Document:
    """What the sweep knows of one document: ids that no common end has closed yet, and sums of what is closed."""

    key: int
    doc_id: int | None
    a: list = field(default_factory=list)
    b: list = field(default_factory=list)
    n_a: int = 0
    n_b: int = 0
    groups: int = 0
    digest: object = None
    codes: list = field(default_factory=list)

    def close(self, text: bytes, n_a: int, n_b: int, codes: np.ndarray, counts: np.ndarray) -> None:
        """Takes closed groups: their text (ends in ';'), numbers of ids, and their links' codes with counts."""
        if self.digest is None:
            self.digest = hashlib.sha256()
        else:
            self.digest.update(b";")
        self.digest.update(memoryview(text)[:-1])
        self.n_a, self.n_b, self.groups = self.n_a + n_a, self.n_b + n_b, self.groups + int(counts.sum())
        if self.codes:
            both, at = np.unique(np.concatenate([self.codes[0], codes]), return_inverse=True)
            codes, counts = both, np.bincount(at, np.concatenate([self.codes[1], counts])).astype(np.int64)
        self.codes = [codes, counts]


class Sweep:
    """Takes runs in the order of (document, offset), emits closed groups; holds an open group and sums, not documents."""

    def __init__(self, tools: Tools):
        self.tools, self.counts = tools, np.zeros(tools.pairs.count, np.int64)
        self.left, self.right = np.zeros(tools.pairs.count, np.uint16), np.zeros(tools.pairs.count, np.uint16)

    def work(self, docs: list[Document], ended: bool) -> None:
        """Closes what common ends close, in all documents at once; the last document goes on unless `ended`."""
        docs = [d for d in docs if d.a or d.b]
        if not docs:
            return
        t, sides = self.tools, []
        for name, entries in (("a", t.a.entries), ("b", t.b.entries)):
            parts = [getattr(d, name) for d in docs]
            ids = np.concatenate([np.zeros(0, np.uint16), *(x for p in parts for x in p)])
            upto = np.cumsum([sum(map(len, p)) for p in parts])
            ends = np.cumsum(entries.sizes[ids])
            sides.append((ids, upto, ends))
        # Offsets over all documents: each begins where the longer side of the one before ends.
        totals = [np.diff(np.append(0, ends)[upto], prepend=0) for _, upto, ends in sides]
        room = np.maximum(*totals)
        marks = []
        for (_, upto, ends), total in zip(sides, totals, strict=True):
            shift = (np.cumsum(room) - room) - (np.cumsum(total) - total)
            ends += np.repeat(shift, np.diff(upto, prepend=0))
            mark = np.zeros(int(room.sum()) + 1, bool)
            mark[ends] = True
            marks.append(mark)
        common = [marks[1 - i][sides[i][2]] for i in range(2)]
        closed = [int(np.flatnonzero(c)[-1]) + 1 if c.any() else 0 for c in common]
        last = docs[-1]
        rest = [ids[n:] for (ids, _, _), n in zip(sides, closed, strict=True)]
        if ended and (len(rest[0]) or len(rest[1])):
            raise RuntimeError("the sides of a document end apart")
        (a, a_upto, _), (b, b_upto, _) = sides
        a_upto, b_upto, ca, cb = np.minimum(a_upto, closed[0]), np.minimum(b_upto, closed[1]), common[0][: closed[0]], common[1][: closed[1]]
        a, b = a[: closed[0]], b[: closed[1]]
        # A group's ids of side a, then of b: where each stands among all.
        a_group, b_group = np.cumsum(ca) - ca, np.cumsum(cb) - cb
        a_ends, b_ends = np.append(0, np.flatnonzero(ca) + 1), np.append(0, np.flatnonzero(cb) + 1)
        text = np.empty(len(a) + len(b), np.uint64)
        text[np.arange(len(a)) + b_ends[a_group]] = np.where(ca, t.a_last[a], t.a_text[a])
        text[np.arange(len(b)) + a_ends[b_group + 1]] = np.where(cb, t.b_last[b], t.b_text[b])
        left, right = a[ca], b[cb]
        codes = t.pairs.code(left, right)
        self.counts += np.bincount(codes, minlength=len(self.counts))
        self.left[codes], self.right[codes] = left, right
        links = np.searchsorted(a_ends[1:], a_upto, "right")  # links up to each document's end
        owner = np.repeat(np.arange(len(docs)), np.diff(links, prepend=0))
        kinds, times = np.unique(owner << 32 | codes, return_counts=True)
        of = np.searchsorted(kinds, np.arange(len(docs) + 1) << 32)
        kinds &= 0xFFFFFFFF
        a0 = b0 = 0
        for i, d in enumerate(docs):
            a1, b1 = int(a_upto[i]), int(b_upto[i])
            if a1 > a0:
                d.close(text[a0 + b0 : a1 + b1].tobytes().translate(None, b"\0"), a1 - a0, b1 - b0, kinds[of[i] : of[i + 1]], times[of[i] : of[i + 1]])
            d.a, d.b, a0, b0 = [], [], a1, b1
        if not ended:
            last.a, last.b = ([x] if len(x) else [] for x in rest)


def small(values: np.ndarray) -> bytes:
    """A mark for the width, then the values in so many bytes each."""
    width = next(w for w in (1, 2, 4, 8) if values.max(initial=0) < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def link_bytes(codes: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending codes as differences, and their counts."""
    return zstandard.ZstdCompressor(level=1).compress(len(codes).to_bytes(4, "little") + small(np.diff(codes, prepend=0)) + small(counts))


def links_of(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n, at, out = int.from_bytes(raw[:4], "little"), 4, []
    for _ in range(2):
        width = raw[at]
        out.append(np.frombuffer(raw, f"<u{width}", n, at + 1).astype(np.int64))
        at += 1 + n * width
    return np.cumsum(out[0]), out[1]


SWEPT = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("links", pa.binary()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])
SWEPT_DDL = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary, a int, b int, n long"


def sweep(events: DataFrame, settings: Settings) -> DataFrame:
    """A row per document, with its links' codes and counts, and (with n) one per task and pair of ids linked in it."""

    def rows(docs: list[Document]) -> pa.RecordBatch:
        out = {"doc_id": [d.doc_id for d in docs], "n_a": [d.n_a for d in docs], "n_b": [d.n_b for d in docs], "n_groups": [d.groups for d in docs]}
        out |= {"groups_sha256": [d.digest.hexdigest() if d.digest else "" for d in docs], "links": [link_bytes(*d.codes) if d.codes else None for d in docs]}
        return arrow_out(SWEPT, out | {c: [None] * len(docs) for c in ("a", "b", "n")})

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = worker_tools(settings)
        machine, docs, held = Sweep(tools), [], 0
        for batch in batches:
            for key, doc_id, side, ids in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "side", "ids")), strict=True):
                if not docs or docs[-1].key != key:
                    if held >= HELD:
                        machine.work(docs, True)
                        yield rows(docs)
                        docs, held = [], 0
                    docs.append(Document(key, doc_id))
                if ids:
                    (docs[-1].b if side else docs[-1].a).append(np.frombuffer(ids, np.uint16))
                    held += len(ids) // 2
                if held >= 2 * HELD:  # within a long document
                    machine.work(docs, False)
                    if docs[:-1]:
                        yield rows(docs[:-1])
                    docs = docs[-1:]
                    held = sum(map(len, docs[0].a + docs[0].b))
        if docs:
            machine.work(docs, True)
            yield rows(docs)
        linked = np.flatnonzero(machine.counts)
        for s in range(0, len(linked), 1 << 16):
            part = linked[s : s + (1 << 16)]
            blank = {c: pa.nulls(len(part), SWEPT.field(c).type) for c in SWEPT.names[:6]}
            yield arrow_out(SWEPT, blank | {"a": machine.left[part].astype(np.int32), "b": machine.right[part].astype(np.int32), "n": machine.counts[part]})
        trim()

    return events.repartition("key").sortWithinPartitions("key", "at", "side").select("key", "doc_id", "side", "ids").mapInArrow(each, SWEPT_DDL)


def align(spark: SparkSession, docs: DataFrame, scratch: Scratch, settings: Settings | None = None) -> DataFrame:
    """A row per document: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Both sides' end events of a text are rows of runs; they are dealt by document and sorted by
    offset, and each task sweeps its documents in one pass that holds an open group. A task sums its
    links by pair of ids; those sums, added up over the corpus, are as many as the vocabularies allow
    (Pairs) and go to all workers, which then sum each document's links.

    Null and empty texts, and texts that their tokens do not spell, have zeros and ''. Repeated rows
    and null doc_ids are documents each. A text is tokenized whole, however long. Empty table: no
    rows. Other columns are not read.
    """
    settings = settings or Settings()
    done = scratch.save(sweep(end_events(docs, settings), settings), "swept")
    counted = done.filter("n is not null").groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    tools = Tools(settings)
    a, b, n = (counted.column(c).to_numpy() for c in ("a", "b", "n"))
    count, most, best = np.zeros(tools.pairs.count, np.int64), np.zeros(len(tools.b.entries.sizes), np.int64), np.zeros(tools.pairs.count, bool)
    codes = tools.pairs.code(a, b)
    np.maximum.at(most, b, n)
    count[codes], best[codes] = n, n == most[b]
    shared = spark.sparkContext.broadcast((count, best))
    schema = pa.schema([(c, pa.string() if c == "groups_sha256" else pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = shared.value
        for batch in batches:
            n_links, n_best, sums = [], [], []
            for packed in batch.column("links").to_pylist():
                codes, times = links_of(packed) if packed else (np.zeros(0, np.int64),) * 2
                n_links.append(int(times.sum()))
                n_best.append(int(times[best[codes]].sum()))
                sums.append(int((times * count[codes]).sum()))
            yield arrow_out(schema, {c: batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")} | {"n_links": n_links, "n_best": n_best, "count_sum": sums})

    return done.filter("n is null").select("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links").mapInArrow(totals, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


_TOOLS: dict[tuple[str, str], Tools] = {}
CACHES.append(_TOOLS)


def worker_tools(settings: Settings) -> Tools:
    """The worker's tools, kept between tasks; what other operators keep goes first."""
    key = (settings.byte_level, settings.pieces)
    if key not in _TOOLS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        release()
        _TOOLS[key] = Tools(settings)
    return _TOOLS[key]
