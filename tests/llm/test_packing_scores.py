"""BM25 over all of a seed's terms, with term frequencies."""

import math

import numpy as np

from ragspark.llm import packing


def plain(terms, lengths, seed, doc, s):
    out, n, mean = 0.0, len(terms), np.mean(lengths)
    for t in set(terms[seed].tolist()) & set(terms[doc].tolist()):
        df, tf = sum(t in x for x in terms), terms[doc].tolist().count(t)
        out += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (s.k1 + 1) / (tf + s.k1 * (1 - s.b + s.b * lengths[doc] / mean))
    return out


def test_all_terms_and_frequencies():
    rng, s = np.random.default_rng(2), packing.Settings()
    terms = [(rng.zipf(1.3, rng.integers(40, 200)) % 300).astype(np.uint32) for _ in range(60)]
    lengths = np.asarray([len(t) for t in terms])
    index, unused = packing.Index(terms, lengths, s), np.ones(60, bool)
    for seed in range(60):
        unused[:] = True
        unused[[seed, (seed + 7) % 60]] = False
        score = {d: plain(terms, lengths, seed, d, s) for d in range(60) if unused[d]}
        got = index.neighbours(seed, unused).tolist()
        assert set(got) == {d for d in score if score[d] > 0}
        assert all(score[a] >= score[b] - 1e-9 for a, b in zip(got, got[1:], strict=False))


def test_a_match_in_a_common_word():
    """A seed of more than 24 rare terms still finds the document that shares only a common one."""
    rare = [np.asarray([i], np.uint32) for i in range(30)]
    terms = [np.arange(31, dtype=np.uint32), *rare, np.asarray([30, 30], np.uint32), np.asarray([30], np.uint32), np.asarray([30], np.uint32)]
    index = packing.Index(terms, np.full(len(terms), 5), packing.Settings())
    unused = np.ones(len(terms), bool)
    unused[0] = False
    assert set(index.neighbours(0, unused).tolist()) == set(range(1, len(terms)))
