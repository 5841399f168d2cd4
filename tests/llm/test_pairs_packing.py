"""Neighbours, near duplicates, components, the n-gram join and packing against brute force."""

import collections
import itertools
import math
import random
import re
import zlib
from dataclasses import replace
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ragspark.llm import ann, jaccard, neardup, packing
from ragspark.llm.common import Scratch, shingles, slices, words_of
from ragspark.llm.components import components

VECTORS = "vec_id long, embedding array<float>, label int"
ODD = [(9001, None, 1), (9002, [], 1), (9003, [0.0] * 8, 1), (9004, [1.0] * 7 + [None], 1), (9005, [1.0] * 7 + [float("nan")], 1), (9006, [1.0] * 7 + [float("inf")], 1), (None, [1.0] * 8, 1), (9007, [1.0, 2.0], 1)]


def vectors(spark, rows):
    return spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 as tree", "'u' as unit", "0 as n_links")


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def some_vectors(n, d=8, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    x[n // 2 : n // 2 + n // 5] = x[0] + 0.05 * rng.standard_normal((n // 5, d))
    return x.astype(np.float32)


@pytest.mark.parametrize("block,queries", [(100_000, 2048), (37, 3)])
def test_ann(spark, scratch, block, queries):
    x = some_vectors(400)
    x[10:15] = x[50]
    rows = [(i * 5, x[i].tolist(), 0) for i in range(400)]
    s = ann.Settings(trees=3, leaf=16, block=block, queries=queries, recall=0.99)
    got = ann.search(spark, vectors(spark, rows + ODD + rows[:3]), scratch, every=50, settings=s).collect()
    u, hits, total = unit(x.astype(float)), 0, 0
    for q in range(0, 400, 10):
        mine = sorted((r for r in got if r.query_id == q * 5), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        score = u @ u[q]
        for r in mine:
            assert r.vec_id % 5 == 0 and r.vec_id != q * 5 and r.score == pytest.approx(score[r.vec_id // 5], abs=1e-12)
        assert [(r.score, r.vec_id) for r in mine] == sorted([(r.score, r.vec_id) for r in mine], key=lambda p: (-p[0], p[1]))
        best = sorted((i for i in range(400) if i != q), key=lambda i: (-round(score[i], 12), i))[:5]
        hits += len({r.vec_id // 5 for r in mine} & set(best))
        total += 5
    assert hits / total >= 0.9


def test_ann_ties_and_few(spark, scratch):
    rows = [(0, [1.0, 0.0], 0), (3, [2.0, 0.0], 0), (2, [1.0, 0.0], 0), (1, [0.0, 1.0], 0)]
    got = ann.search(spark, vectors(spark, rows), scratch).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(1, 2, 1.0), (2, 3, 1.0), (3, 1, 0.0)]
    assert ann.search(spark, vectors(spark, []), scratch).count() == 0
    assert ann.search(spark, vectors(spark, [(0, None, 1)]), scratch).count() == 0


def test_ann_exact(spark, scratch):
    """A budget of all rows in all trees is an exact search; copies beyond the k + 1 smallest ids change nothing."""
    x = some_vectors(300)
    x[40:140] = x[7]  # a third of all rows are one vector
    rows = [(i * 5, x[i].tolist(), 0) for i in range(300)]
    got = ann.search(spark, vectors(spark, rows), scratch, every=50, settings=ann.Settings(rows=4 * 300, leaf=16, block=64)).collect()
    u = unit(x.astype(float))
    for q in range(0, 300, 10):
        score = u @ u[q]
        want = sorted((i for i in range(300) if i != q), key=lambda i: (-round(score[i], 12), i))[:5]
        assert [r.vec_id // 5 for r in sorted((r for r in got if r.query_id == q * 5), key=lambda r: r["rank"])] == want


def test_ann_reads_little_of_clusters(spark, scratch):
    """In vectors that form clusters recall is kept with a small part of the rows."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((100, 16))
    x = (centres[rng.integers(0, 100, 6000)] + 0.1 * rng.standard_normal((6000, 16))).astype(np.float32)
    rows = [(i, x[i].tolist(), 0) for i in range(6000)]
    read = []

    class Watched(type(scratch)):
        def save(self, df, name):
            out = super().save(df, name)
            if name == "routed":
                read.append(out)
            return out

    watched = Watched(spark, "watched")
    s = ann.Settings(leaf=32)
    got = ann.search(spark, vectors(spark, rows), watched, every=50, settings=s).collect()
    u = unit(x.astype(float))
    hits = 0
    for q in range(0, 6000, 50):
        score = u @ u[q]
        score[q] = -2
        hits += len({r.vec_id for r in got if r.query_id == q} & set(np.argsort(-score, kind="stable")[:5].tolist()))
    assert hits / 600 >= 0.9
    leaves = read[0].select("id", "tree", F.explode("leaves").alias("leaf"))
    sizes = spark.read.parquet(watched.path("placed")).filter("candidate").select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").count()
    rows_read = leaves.join(sizes, ["tree", "leaf"]).agg(F.sum("count")).first()[0]
    assert rows_read / 120 < 0.2 * 6000


def clusters(n, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 60, 16))
    return (centres[rng.integers(0, len(centres), n)] + 0.1 * rng.standard_normal((n, 16))).astype(np.float32)


#: A sample so small that its trees end early: leaves go on as trees of their own, one and two levels down.
DEEP = [ann.Settings(leaf=16, sample=128, most=32, block=200, queries=9), ann.Settings(trees=2, leaf=8, sample=64, most=24, block=64, queries=500)]


@pytest.mark.parametrize("settings", DEEP)
def test_ann_trees_within_leaves(spark, settings):
    """Leaves stay small though the table grows fourfold, recall holds, and a query reads hardly more rows."""
    read = []
    for n in (1500, 6000):
        x, scratch = clusters(n), Scratch(spark, "deep")
        got = ann.search(spark, vectors(spark, [(i, x[i].tolist(), 0) for i in range(n)] + ODD), scratch, every=50, settings=settings).toPandas()
        u, hits = unit(x.astype(float)), 0
        for q in range(0, n, 50):
            score = u @ u[q]
            score[q] = -2
            mine = got[got.query_id == q].sort_values("rank")
            assert mine["rank"].tolist() == [1, 2, 3, 4, 5] and np.allclose(mine.score, score[mine.vec_id], atol=1e-12)
            hits += len(set(mine.vec_id) & set(np.argsort(-score, kind="stable")[:5].tolist()))
        assert hits / (n // 50 * 5) >= 0.9
        last = max(int(f.name.split("-")[1]) for f in Path(scratch.root.removeprefix("file:")).glob("counts-*"))
        counts = spark.read.parquet(scratch.path(f"counts-{last}"))
        assert last and counts.agg(F.max("rows")).first()[0] <= settings.most
        leaves = spark.read.parquet(scratch.path("routed")).select("id", "tree", F.explode("leaves").alias("leaf"))
        read.append(leaves.join(counts, ["tree", "leaf"]).agg(F.sum("rows")).first()[0] / (n // 50))
    assert read[1] < 2 * read[0]


def test_ann_trees_within_leaves_exact(spark, scratch):
    """A budget of all rows enters every leaf of every tree, however deep."""
    x = clusters(900)
    x[40:340] = x[7]  # a third of all rows are one vector
    got = ann.search(spark, vectors(spark, [(i, x[i].tolist(), 0) for i in range(900)]), scratch, every=50, settings=replace(DEEP[0], rows=4 * 900)).toPandas()
    u = unit(x.astype(float))
    for q in range(0, 900, 50):
        score = u @ u[q]
        want = sorted((i for i in range(900) if i != q), key=lambda i: (-round(score[i], 12), i))[:5]
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == want


def test_ann_recall_on_the_table(spark, scratch, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    d = v.toPandas()
    x = unit(np.stack(d.embedding).astype(float))
    got = ann.search(spark, v, scratch).toPandas()
    s = x @ x.T
    np.fill_diagonal(s, -2)
    hits = sum(len(set(g.vec_id) & set(d.vec_id.iloc[np.argsort(-s[d.index[d.vec_id == q][0]])[:5]])) for q, g in got.groupby("query_id"))
    assert hits / len(got) >= 0.9


def test_quantisation_bounds():
    x, y = unit(some_vectors(300, 16, 1).astype(float)), unit(some_vectors(300, 16, 2).astype(float))
    a, b = neardup.quantise(x), neardup.quantise(y)
    near = (a.q.astype(float) @ b.q.astype(float).T) * a.scale[:, None] * b.scale
    bound = a.size[:, None] * b.error + a.error[:, None] * (b.size + b.error)
    assert (np.abs(x @ y.T - near) <= bound + 1e-12).all() and bound.max() < 0.05


def brute_near(rows, least=0.98):
    """{vec_id: (links, component)} of distinct ids."""
    good = {i: unit(np.asarray(v, float)) for i, v, label in rows if label is not None and v and None not in v and np.isfinite(v).all() and np.any(np.asarray(v) != 0)}
    label = {i: g for i, _, g in rows}
    link = {i: set() for i, *_ in rows}
    for i, j in itertools.combinations(good, 2):
        if label[i] == label[j] and len(good[i]) == len(good[j]) and good[i] @ good[j] >= least:
            link[i].add(j)
            link[j].add(i)
    return {i: (len(link[i]), min(reach(i, link))) for i in link}


def reach(i, link):
    seen, todo = {i}, [i]
    while todo:
        for j in link[todo.pop()]:
            if j not in seen:
                seen.add(j)
                todo.append(j)
    return seen


@pytest.mark.parametrize("tile,strip", [(2048, 512), (20, 7)])
def test_near_duplicates(spark, scratch, tile, strip):
    x = some_vectors(200, 8, 3)
    rows = [(1000 - i, x[i].tolist(), [0, 1, None][min(2, i % 41 // 20)]) for i in range(200)]
    odd = [r for r in ODD if r[0] is not None]
    got = neardup.near_duplicates(vectors(spark, rows + ODD + rows[:2]), scratch, neardup.Settings(tile=tile, strip=strip)).collect()
    want = brute_near(rows + odd)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id is not None} == want
    assert len(got) == len(want) + 1 and all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert max(n for n, _ in want.values()) > 5


def test_near_duplicates_empty(spark, scratch):
    assert neardup.near_duplicates(vectors(spark, []), scratch).count() == 0


def test_components(spark, scratch):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(150)] + [(500, 500 + i) for i in range(1, 60)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    link: dict = {}
    for a, b in edges:
        link.setdefault(a, set()).add(b)
        link.setdefault(b, set()).add(a)
    assert got == {i: min(reach(i, link)) for i in link if link[i] != {i}}
    assert components(spark.createDataFrame([], "a long, b long"), scratch, "none").count() == 0


def test_words_and_slices():
    texts = pa.array([" A b\x0bc ", None, "", "é  Éb\x1f \x85x", "a"])
    words, codes, ends = words_of(texts)
    got = [[words[int(c)].as_py() for c in codes[a:b]] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    low = str.maketrans({i: i + 32 for i in range(65, 91)})
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", (t.as_py() or "").translate(low)) for t in texts]
    batch = pa.record_batch({"text": ["x" * n for n in (5, 5, 50, 1, 1)]})
    assert [s.num_rows for s in slices(batch, limit=10)] == [2, 1, 2]


def test_shingles_tell_lengths_apart():
    a, b, c = (np.uint64(x) for x in (11, 22, 33))
    arr = lambda *x: np.asarray(x, np.uint64)
    sets = [shingles(arr(*x), 3) for x in ((), (a,), (a, b), (b, a), (a, b, c), (a, b, c, a, b, c))]
    assert [len(s) for s in sets] == [0, 1, 1, 1, 1, 3]
    assert len({s.tobytes() for s in sets}) == 6


@pytest.mark.parametrize("least", [80, 90, 95])
def test_linked_sets_share_enough_signatures(least):
    """The module's claim, over random sets and any choice of levels."""
    rng = np.random.default_rng(least)
    checked = 0
    for _ in range(3000):
        n = int(rng.integers(1, 90))
        bits = 6
        levels = rng.choice([0, 1, 7, jaccard.TOP], 1 << bits, p=rng.dirichlet([0.5] * 4)).astype(np.uint8)
        x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        d = jaccard.allowed(len(x), least)[1]
        gone = int(rng.integers(0, d + 1))
        y = np.unique(np.concatenate([rng.permutation(x)[gone:], rng.integers(0, 2**64, int(rng.integers(0, d - gone + 1)), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 100 * both < least * (len(x) + len(y) - both) or np.array_equal(x, y) or not len(y):
            continue
        checked += 1
        (a, need_a), (b, need_b) = (jaccard.signatures(s, levels, least) for s in (x, y))
        shared = len(np.intersect1d(a, b))
        assert shared >= max(1, need_a, need_b), (len(x), len(y), both)
        differ = int(np.bitwise_count(jaccard.parity(x).view(np.uint64) ^ jaccard.parity(y).view(np.uint64)).sum())
        assert differ <= len(x) + len(y) - 2 * both
    assert checked > 300


def brute_join(rows):
    low = str.maketrans({i: i + 32 for i in range(65, 91)})
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w)} if 0 < len(w) < 3 else {tuple(w[i : i + 3]) for i in range(len(w) - 2)})
    link = {i: set() for i in range(len(rows))}
    for i, j in itertools.combinations(link, 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 90 * len(sets[i] | sets[j]):
            link[i].add(j)
            link[j].add(i)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in reach(i, link) if rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids) if sets[i] and ids else doc))
    return sorted(out, key=repr), sets, link


def corpus(seed, n=120):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("a b c d e f g h i j k".split()) + str(rng.randrange(30)) for _ in range(rng.choice([1, 2, 3, 12, 60, 200]))) for _ in range(20)]
    shared = " ".join(f"p{i}" for i in range(60))
    rows = []
    for i in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(["zz", "Yy", "q"])
        rows.append((i, " ".join(w) + (" " + shared if rng.random() < 0.4 else "")))
    return rows


@pytest.mark.parametrize("seed,bits", [(0, 23), (1, 8), (2, 6)])
def test_join_against_brute_force(spark, docs, scratch, seed, bits):
    rows = corpus(seed) + [(500, None), (501, ""), (502, " \n"), (503, "One"), (504, "one "), (None, "one"), (None, "alone here now and then"), (505, "B c"), (505, "B c"), (506, "w " * 40_000)]
    got = jaccard.jaccard_components(spark, docs(rows), scratch, jaccard.Settings(bits=bits)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_join(rows)[0]


def test_join_empty(spark, docs, scratch):
    assert jaccard.jaccard_components(spark, docs([]), scratch).count() == 0
    assert jaccard.keep_one(spark, docs([]), scratch).count() == 0


def test_join_sql(spark, scratch, sf_dir):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = jaccard.jaccard_components(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch)
    assert sorted(tuple(r) for r in got.collect()) == sorted(c.execute(jaccard.JACCARD_SQL).fetchall())


@pytest.mark.parametrize("broadcast", [True, False])
def test_keep_one(spark, docs, scratch, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(jaccard, "BROADCAST_ROWS", -1)
    rows = corpus(3) + [(500, None), (501, ""), (2, "another text of a repeated id"), (None, "alone here now and then"), (None, "alone here now and then"), (700, "alone here now and then"), (701, "twin text of one id"), (701, "twin text of one id")]
    d = docs(rows)
    kept = jaccard.keep_one(spark, d, scratch, jaccard.Settings(bits=10))
    assert kept.columns == d.columns
    _, sets, link = brute_join(rows)
    left = [(r.doc_id, r.text) for r in kept.collect()]
    given = {(i, t) for i, t in rows}
    want = []
    for i, (doc, text) in enumerate(rows):
        group = reach(i, link)
        ids = [(rows[j][0] is None, rows[j][0] or 0) for j in group]
        if not sets[i]:
            want.append((doc, text))
        elif (doc is None, doc or 0) == min(ids) and i == min(j for j in group if (rows[j][0] is None, rows[j][0] or 0) == min(ids)):
            want.append((doc, text))
    assert len(left) == len(want) and {x[0] for x in left} == {x[0] for x in want} and set(left) <= given
    once = [i for i, n in collections.Counter(i for i, _ in rows).items() if n == 1]
    assert sorted(x for x in left if x[0] in once) == sorted(x for x in want if x[0] in once)  # whole texts


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def test_word_ids_are_the_tokenizers(tokenizer):
    rng = random.Random(0)
    pieces = ["Ab", "it's", "é", "é", "naïve,", "12", "3.5", "...", "x²y", " ", " z", "<|endoftext|>", "<|ENDOFTEXT|>", "don't!", "日本", "ǅ.", "'re", "a.b", "İ", "ß;", "́.", "ok?!", "K"]
    texts = [rng.choice(["", " "]).join(rng.choice(pieces) for _ in range(8)) + rng.choice([" ", "\n", ""]) for _ in range(400)]
    ids, terms = packing.encode(pa.array([*texts, None, ""]), packing.Encoder(packing.default_tokenizer()))
    for t, x in zip(texts, ids, strict=False):
        assert tokenizer.encode(t, add_special_tokens=False).ids == x.tolist(), t
    assert len(ids[-1]) == len(ids[-2]) == 0


def check_pieces(rows, got, tokenizer, window):
    by_sequence: dict = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    pad = 0
    for s in by_sequence.values():
        s.sort(key=lambda r: r.offset)
        total = 0
        for r in s:
            assert r.offset == total and r.length > 0
            total += r.length
        assert total <= window
        pad += 0 if total & (total - 1) == 0 else window - total
    want: dict = {}
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want.setdefault(doc, []).append(ids)
    for doc, lists in want.items():
        mine = sorted((r for r in got if r.doc_id == doc), key=lambda r: r.start)
        assert sum(r.length for r in mine) == sum(map(len, lists))
        if len(lists) == 1:
            (ids,) = lists
            upto = 0
            for r in mine:
                assert r.start == upto and r.doc_tokens == len(ids)
                assert r.ids_crc32 == zlib.crc32(np.asarray(ids[upto : upto + r.length], "<u4").tobytes())
                upto += r.length
    return pad, sum(r.length for r in got)


@pytest.mark.parametrize("window,shard", [(2048, 1_500_000), (16, 300)])
def test_packing(spark, docs, tokenizer, window, shard):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("stars burn hydrogen cells hear sounds".split()) for _ in range(rng.randrange(60)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "long text " * 5000), (None, "nobody"), (0, "again"), (0, "again")]
    got = packing.pack_documents(docs(rows), settings=packing.Settings(window=window, shard=shard)).collect()
    pad, total = check_pieces(rows, got, tokenizer, window)
    assert pad == 0 and total > 0
    assert packing.pack_documents(docs([])).count() == 0


def test_copies_meet_whatever_the_files(spark, docs, tokenizer):
    """Copies far apart in the table lie in shared sequences, in shards of some 30 documents; one text of many rows stays whole."""
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(40)) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5000 + i, "one text of many rows") for i in range(300)] + [(1000 + i, t) for i, t in enumerate(texts)]
    got = packing.pack_documents(docs(rows).repartitionByRange(4, "doc_id"), settings=packing.Settings(window=512, shard=4000)).collect()
    check_pieces(rows, got, tokenizer, 512)
    at: dict = {}
    for r in got:
        at.setdefault(r.doc_id, set()).add(r.sequence_id)
    assert sum(bool(at[i] & at[1000 + i]) for i in range(300)) >= 285


def test_routing_key():
    terms = np.asarray([512, 256, 7, 7, 263], np.uint32)
    assert packing.routed(terms) == 7 << 32 | 7 and packing.routed(terms[:0]) == 0
    assert packing.routed(terms[[0, 1]]) == 256 and packing.routed(terms) == packing.routed(terms[::-1])


def test_neighbours_share_windows():
    """Two topics, alternating: a window is of one topic wherever documents of its seed's topic are left."""
    s = packing.Settings(window=40)
    rng = np.random.default_rng(0)
    ids = [np.zeros(10, np.uint32) for _ in range(40)]
    terms = [np.unique(rng.integers(100 * (i % 2), 100 * (i % 2) + 30, 12).astype(np.uint32)) for i in range(40)]
    topics: dict = {}
    for doc, _, _, sequence, _ in packing.pack(ids, terms, s):
        topics.setdefault(sequence, set()).add(doc % 2)
    assert all(len(t) == 1 for t in topics.values())


def test_bm25_order():
    s = packing.Settings(terms=10)
    terms = [np.asarray(t, np.uint32) for t in ([1, 2, 3], [1], [1, 2], [9], [1, 2, 3])]
    lengths = np.asarray([3, 1, 2, 1, 30])
    index = packing.Index(terms, lengths, s)
    unused = np.asarray([False, True, True, True, True])

    def bm25(doc):
        mean = lengths.mean()
        out = 0.0
        for t in set(terms[0].tolist()) & set(terms[doc].tolist()):
            df = sum(t in x for x in terms)
            out += math.log(1 + (5 - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * lengths[doc] / mean))
        return out

    want = sorted((d for d in (1, 2, 4)), key=lambda d: -bm25(d))
    assert index.neighbours(0, unused).tolist() == want


def test_index_of_rows_and_lists_shrinks_with_its_documents(monkeypatch):
    """An index summed all postings for each seed, also those of documents that were used: rows, lists and their mixtures rank alike."""
    import numpy as np

    from ragspark.llm import packing

    rng = np.random.default_rng(4)
    terms = [rng.zipf(1.3, n).clip(max=400).astype(np.uint32) for n in rng.integers(0, 90, 120)]
    lengths = np.asarray([len(t) * 2 + 1 for t in terms])
    seeds, found = rng.permutation(120), {}
    for dense in (0, 2, 8, 10**6):  # no rows, rows of what most have, a mixture, rows alone
        monkeypatch.setattr(packing, "DENSE", dense)
        index, unused = packing.Index(terms, lengths, packing.Settings()), np.ones(120, bool)
        cells = index.dense.size + len(index.docs)
        for seed in seeds:
            unused[seed] = False
            found.setdefault(int(seed), []).append(index.neighbours(int(seed), unused).tolist())
        assert (dense == 0) == (not (index.row >= 0).any()) and index.dense.size + len(index.docs) < cells / 8
    assert all(all(x == lists[0] for x in lists) for lists in found.values()) and max(len(x[0]) for x in found.values()) > 100
