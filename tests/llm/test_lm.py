"""The backoff automaton against plain code, at several orders, levels of sums and pieces."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ragspark.llm import lm

LOW = str.maketrans({i: i + 32 for i in range(65, 91)})


def plain_lm(rows, order=2, mu=256.0):
    words = [[0, *re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)), None] for _, t in rows]
    fold = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    c, histories = collections.Counter(), collections.Counter()
    for w, out in zip(words, fold, strict=True):
        for i in range(1, len(w)) if not out else ():
            for k in range(1, order + 1):
                if i - k + 1 >= 0:
                    c[tuple(w[i - k + 1 : i + 1])] += 1
                    histories[tuple(w[i - k + 1 : i])] += 1
    n, v = sum(x for g, x in c.items() if len(g) == 1), sum(len(g) == 1 for g in c)

    def p(h, w):
        if not h:
            return (c[(w,)] + 1) / (n + v + 1)
        return (c[(*h, w)] + mu * p(h[1:], w)) / (histories[h] + mu) if h != (0,) else (c[(0, w)] + mu * p((), w)) / (histories[h] + mu)

    res = []
    for (i, _), w, out in zip(rows, words, fold, strict=True):
        base = sum(math.log10(p((), x)) for x in w[1:])
        score = sum(math.log10(p(tuple(w[max(0, j - order + 1) : j]), w[j])) for j in range(1, len(w)))
        res.append((i, out, len(w) - 1, sum(c[(x,)] > 0 for x in w[1:]), n, base, score))
    return res


@pytest.mark.parametrize("order,chunk,bits,piece", [(2, 300, 10, 256), (2, 10**9, 10, 7), (2, 300, 2, 4), (3, 300, 1, 3), (3, 10**9, 10, 256), (4, 900, 2, 5), (1, 300, 3, 8)])
def test_against_plain(docs, scratch, order, chunk, bits, piece):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("A b c dd É ee the".split()) for _ in range(rng.randrange(60)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, " \t b\x0bc "), (None, "b c"), (0, "b"), (0, "b"), (203, "never seen " * 3000), *[(204, "hot row")] * 50]
    got = [tuple(r) for r in lm.score(docs(rows), scratch, lm.Settings(order=order, chunk=chunk, bits=bits, piece=piece)).collect()]
    key = lambda r: (repr(r[0]), r[2], round(r[6], 6))
    got, want = sorted(got, key=key), sorted(plain_lm(rows, order), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


@pytest.mark.parametrize("order", [2, 3])
def test_sums_to_one(order):
    """After any history, the words of the vocabulary and the share of unseen ones add up to 1."""
    rng = random.Random(6)
    known = [" ".join(rng.choice("abcde") for _ in range(9)) for _ in range(20)]
    for history in ("", "a", "b c", "e e", "zz", "a zz"):
        ask = [f"{history} {w}".strip() for w in "abcde"] + [history, f"{history} unseen".strip()]
        times = np.asarray([1] * 20 + [0] * len(ask))
        c = lm.chunk_of(pa.array(known + ask), times, order)
        tokens = (c.grams & lm.LONGER) == 0
        n, v = int(c.counts[tokens].sum()), int((c.counts[tokens] > 0).sum())
        a = lm.Automaton(c, c.counts, n, v, lm.Settings(order=order, prior=3.0))
        total = 0.0
        for i in range(20, 20 + len(ask)):
            state, at = np.asarray([c.begin]), len(history.split())
            for t in range(c.ends[i], c.ends[i] + at):
                state, _ = a.step(state, np.asarray([t]))
            total += 10 ** a.step(state, np.asarray([c.ends[i] + at]))[1][0]
        assert total == pytest.approx(1)


def test_failure_arcs_form_chains():
    c = lm.chunk_of(pa.array(["a b c d", "a b c e", "x b c d"]), np.ones(3, np.int64), 3)
    a = lm.Automaton(c, c.counts, 15, 8, lm.Settings(order=3))
    states = np.flatnonzero(a.length[:-1] == 2)
    for s in states:  # two words, one word, the root
        assert a.length[a.fail[s]] == 1 and a.fail[a.fail[s]] == lm.ROOT
    assert a.fail[c.begin] == lm.ROOT


def test_messages_stay_alike(docs, scratch):
    """Twice the chunks: twice the messages a level, not four times, and no task sums more than 2**bits nodes."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(30))) for i in range(400)]
    sent: dict = {}

    class Watched(type(scratch)):
        def save(self, df, name):
            out = super().save(df, name)
            if name.startswith("sent"):
                sent.setdefault(len(sent), (name, out.count(), out.groupBy("prefix", "up").count().agg({"count": "max"}).first()[0]))
            return out

    counts = []
    for half in (rows[:200], rows):
        sent.clear()
        lm.score(docs(half), Watched(docs([]).sparkSession, "watched"), lm.Settings(chunk=500, bits=2)).count()
        assert all(most <= 4 for _, _, most in sent.values())
        counts.append({name: n for name, n, _ in sent.values()})
    assert counts[1]["sent1"] < 2.2 * counts[0]["sent1"]
    assert len(counts[0]) >= 2 and all(n <= 1.25 * c["sent1"] for c in counts for n in c.values())  # no level sends more than the first


def test_empty(docs, scratch):
    assert lm.score(docs([]), scratch).count() == 0


def test_packing():
    v = np.unique(np.random.default_rng(0).integers(0, 2**64, 1000, dtype=np.uint64))
    assert np.array_equal(lm.unpack(lm.pack(v)), v) and np.array_equal(lm.unpack_counts(lm.pack_counts(np.arange(300))), np.arange(300))
    assert len(lm.unpack(lm.pack(v[:0]))) == 0
