"""Toxicity's model and the greedy packer against plain code, hot signatures, and a word cache that forgets."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from ragspark.llm import jaccard, packing, toxicity
from ragspark.llm.chargrams import gram_hashes
from ragspark.llm.common import crc_mod_py


def grams_of(text, orders):
    low = text.lower()
    return {low[i : i + n] for n in orders for i in range(len(low) - n + 1)}


def hashed(gram):
    return int(list(gram_hashes(gram, (len(gram),)))[-1][-1])


def g2(p, q, n1, n0):
    term = lambda a, n: (a * math.log(a / n) if a else 0) + ((n - a) * math.log((n - a) / n) if n - a else 0)
    return 2 * (term(p, n1) + term(q, n0) - term(p + q, n1 + n0))


@pytest.mark.parametrize("features", [40, 4096])
def test_toxicity_by_brute_force(spark, docs, scratch, features):
    rng = random.Random(4)
    bad, good = "foul nasty vile rotten".split(), "calm bright gentle river".split()
    rows = [(i, " ".join(rng.choice(bad if rng.random() < (0.5 if i % 2 else 0.05) else good) for _ in range(8))) for i in range(90)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(90)], "doc_id long, toxic int")
    s = toxicity.Settings(features=features, rounds=4000)
    model = toxicity.fit(spark, docs(rows), labels, scratch, s)
    taught = [(grams_of(t, s.orders), i % 2) for i, t in rows if crc_mod_py(i, 3) != 1]
    n1, n0 = sum(y for _, y in taught), sum(1 - y for _, y in taught)
    count, buckets, by_hash = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()], {}
    for g, y in taught:
        by_hash |= {x: hashed(x) for x in g if x not in by_hash}
        count[y].update(g)
        buckets[y].update({by_hash[x] >> (64 - s.bits) for x in g})
    strength = {b: g2(buckets[1][b], buckets[0][b], n1, n0) for b in set(buckets[0]) | set(buckets[1]) if buckets[0][b] + buckets[1][b] >= 2}
    chosen = {b for b in sorted(strength, key=lambda b: (-round(strength[b], 9), b))[:features] if strength[b] > 1e-9}
    inside = [x for x, h in by_hash.items() if h >> (64 - s.bits) in chosen]
    told = {x: g2(count[1][x], count[0][x], n1, n0) for x in inside}
    if features < len(told):  # ties at the edge may go either way
        edge = sorted(told.values(), reverse=True)[features - 1]
        must, may = {by_hash[x] for x in told if told[x] > edge + 1e-9}, {by_hash[x] for x in told if told[x] >= edge - 1e-9}
    else:
        must = may = {by_hash[x] for x in told}
    held = {int(h) for h in model.hashes}
    assert must <= held <= may and len(held) == min(features, len(told))
    ratio = {by_hash[x]: math.log(((count[1][x] + 1) / (n1 + 2)) / ((count[0][x] + 1) / (n0 + 2))) for x in inside}
    weight = dict(zip(map(int, model.hashes), model.weights, strict=True))
    z = [model.bias + sum(weight[by_hash[x]] for x in g if by_hash[x] in weight) for g, _ in taught]
    error = [1 / (1 + math.exp(-a)) - y for a, (_, y) in zip(z, taught, strict=True)]
    assert abs(sum(error)) < 1e-3  # the penalised likelihood's slope is 0 in the bias and in every coefficient
    for x in inside:
        h = by_hash[x]
        if h in weight and abs(ratio[h]) > 1e-6:
            slope = sum(e for e, (g, _) in zip(error, taught, strict=True) if x in g) * ratio[h] + s.penalty * weight[h] / ratio[h]
            assert abs(slope) < 1e-2
    got = {r.doc_id: r for r in toxicity.score(spark, docs(rows), model).collect()}
    for i, t in rows:
        want = 1 / (1 + math.exp(-(model.bias + sum(weight.get(hashed(x), 0.0) for x in grams_of(t, s.orders)))))
        assert got[i].score == pytest.approx(want, abs=1e-9) and got[i].predicted == int(want >= 0.7) and got[i].held_out == (crc_mod_py(i, 3) == 1)


def plain_order(lengths, terms, window, k1=1.2, b=0.75):
    """Documents as a greedy packer takes them, with BM25 written out."""
    n, mean = len(terms), max(1.0, sum(lengths) / len(lengths))
    tf = [collections.Counter(t.tolist()) for t in terms]
    df = collections.Counter(x for t in tf for x in t)

    def ranked(seed, free):
        scores = {}
        for d in free:
            shared = [x for x in tf[seed] if x in tf[d] and df[x] > 1]
            if shared:
                scores[d] = sum(math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * tf[d][x] * (k1 + 1) / (tf[d][x] + k1 * (1 - b + b * lengths[d] / mean)) for x in shared)
        return sorted(scores, key=lambda d: (-round(scores[d], 9), d))

    free, order, near, at = list(range(n)), [], [], 0
    while free:
        near = [d for d in near if d in free]
        new = not (at and near)
        doc = free[0] if new else near.pop(0)
        free.remove(doc)
        order.append(doc)
        crossed = at + lengths[doc] >= window
        at = (at + lengths[doc]) % window
        if (new or crossed) and at:
            near = ranked(doc, free)
    return order


@pytest.mark.parametrize("seed", range(6))
def test_greedy_packing_by_brute_force(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 40, 60)
    terms = [np.sort(rng.integers(0, 60, rng.integers(1, 12))).astype(np.uint32) for _ in range(60)]
    pieces = packing.pack([np.zeros(n, np.uint16) for n in lengths], terms, packing.Settings(window=64))
    order = list(dict.fromkeys(p[0] for p in pieces))
    assert order == plain_order(lengths.tolist(), terms, 64)


def test_forgetful_cache():
    rng = random.Random(2)
    words = list({"".join(rng.choice("abcdefgh") for _ in range(5)) + rng.choice(["", ".", ",!"]) for _ in range(3000)})
    small, large = (packing.Encoder(packing.default_tokenizer(), most) for most in (20_000, 1 << 30))
    key = np.asarray([hash(w) & 0xFFFFFFFF for w in words], np.uint64)
    for _ in range(30):
        pick = rng.sample(range(len(words)), 200)
        mine, theirs = (e.words([words[i] for i in pick], key[pick]) for e in (small, large))
        assert all(np.array_equal(a, b) for a, b in zip(mine, theirs, strict=True))
        want = [large.tokenizer.encode(words[i], add_special_tokens=False).ids for i in pick]
        assert mine[0].tolist() == [len(x) for x in want] and mine[1].tolist() == [i for x in want for i in x]
    assert len(small.recent.keys) + len(small.older.keys) < 1500 < len(large.recent.keys)


def test_tokenizer_without_marks_and_large_vocabulary():
    words = ["some", "words,", "and", "more<|", "42"]
    plain, wide = packing.Encoder(packing.default_tokenizer()), packing.Encoder(packing.default_tokenizer())
    wide.mark, wide.kind = None, np.dtype(np.uint32)
    wide.recent, wide.older = packing.Known(wide.kind), packing.Known(wide.kind)
    text = pa.array(["some words, and 42 more", "x <|endoftext|> y"])
    a, b = packing.encode(text, plain)[0], packing.encode(text, wide)[0]
    assert [x.tolist() for x in a] == [x.tolist() for x in b] and b[0].dtype == np.uint32
    assert plain.tokenized(words)[0].tolist()[3] == 0 and wide.tokenized(words[:3])[1].tolist() == plain.tokenized(words[:3])[1].tolist()


def test_piles_of_a_hot_signature(spark, docs, scratch):
    """One signature of 2,000 sets is copied 32 times over; piles are as many as these rows ask for."""
    rows = [(7, k * 7919, k * 7919, 50, [k] * 16) for k in range(2000)] + [(k, k, k, 50, [k] * 16) for k in range(100, 400)]
    members = spark.createDataFrame(rows, "signature long, set_key long, component long, n long, parity array<long>")
    join = jaccard.Join(spark, docs([]), scratch)
    piles = [r["count"] for r in join.piled(members, 64, 2000).groupBy("pile").count().collect()]
    assert sum(piles) == 2000 * 32 + 300 and len(piles) > 20 and max(piles) < 3 * 2000
