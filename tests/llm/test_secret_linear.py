"""Hostile texts take time in proportion to their length, and overlaps are found by one sweep."""

import random
import time

import pytest

from ragspark.llm import secrets

KEY = "kR9vLw2qT8nZx4Bf7Hj1"


@pytest.mark.parametrize("text", ["a//" * 10_000 + "12345x", "a_/" * 10_000 + "12345x", "a-/" * 10_000 + "12345x", "x" * 1_000_000 + "1", "a" * 50 + "0" * 1_000_000, "token" + " " * 1_000_000, "token   " * 100_000, f"secret={KEY} {KEY} " * 25_000, "A1b-" * 250_000])
def test_linear(text):
    began = time.perf_counter()
    secrets.scan(text)
    assert time.perf_counter() - began < 5


def test_ten_megabytes_of_keys():
    text = f"secret={KEY} {KEY} " * 210_000
    base, spans = secrets.scan(text)
    assert len(base) == 210_000 and len(spans) == 420_000
    assert secrets.redact(text).count("[REDACTED]") == 420_000


def test_overlaps_by_brute_force():
    rng = random.Random(3)
    parts = ["password=", "api_key: ", KEY, "AKIA" + "Q7" * 9, "0123456789ab", "deadbeef" * 4, " ", "/", "-", "word", KEY[::-1]]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        base, spans = secrets.scan(text)
        inside = lambda a, b: any(s <= a and b <= e for s, _, e in base)
        entropy = [(m.start() + a, 3, m.start() + b) for m in secrets.CANDIDATE.finditer(text) if not m[0].isalpha() for a, b in secrets.high_entropy(m[0])]
        assert spans == sorted(base + [s for s in entropy if not inside(s[0], s[2])])


@pytest.mark.parametrize("run", [20, 21, 40])
def test_runs_of_one_character(run):
    assert secrets.scan("x" * run + "=" + "Z" * run + "1q") == ([], [])
