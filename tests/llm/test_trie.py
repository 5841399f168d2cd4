"""The conversations' trie against plain code, with conversations cut into many parts, and on hostile rows."""

import hashlib
import random
import re
import zlib

import pytest

from ragspark.llm import trie
from ragspark.llm.trie import Settings

FIELDS = "conv_id long, turn long, role string, text string, depth int, owner string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trunc_mod(a, m):
    return a % m if a >= 0 else -(-a % m)


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    convs = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in convs.items()}
    paths = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = convs.get(c - trunc_mod(c, 20), [])[:h] + own[h:]
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(tuple(p[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        leaves, saved = (0, 0) if kids.get(p) else (1, 0)
        if p:
            saved += (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1]))
        for k in kids.get(p, []):
            more = below(k)
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves, saved

    out = []
    for p, m in members.items():
        ends = sorted(c for c in m if len(paths[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), *below(p), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, scratch, rows, settings=Settings()):
    df = spark.createDataFrame([(*r, 3, "x") for r in rows], FIELDS)
    got = trie.prefix_trie(df, scratch, settings)
    assert got.columns == COLUMNS and all(t == "bigint" for _, t in got.dtypes[:-1])
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_plain_code(spark, scratch, seed):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-45, 90), 70):
        if rng.random() < 0.2 and rows:  # copies of another conversation
            other = rng.choice(rows)[0]
            rows += [(c, t, r, x) for o, t, r, x in rows if o == other]
        else:
            rows += [(c, None if rng.random() < 0.1 else t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", " ", "", None, "é f g"])) for t in range(rng.randint(1, 9))]
    rng.shuffle(rows)
    check(spark, scratch, rows, Settings(segment=2, bits=1))


def test_one_conversation_holds_most_turns(spark, scratch):
    rows = [(5, t // 2, "user", f"w{t % 3} x") for t in range(300)] + [(7, t // 2, "user", f"w{t % 3} x") for t in range(200)] + [(c, 0, "user", "hello there") for c in range(40, 60)]
    check(spark, scratch, rows, Settings(segment=16))


def test_nested_chains_repeated_rows_and_turnless(spark, scratch):
    turn = lambda c, t, x: (c, t, "user", x)
    nested = [turn(20 * c, t, f"same {t}" if t <= c else f"own {c} {t}") for c in range(1, 12) for t in range(c + 3)]
    check(spark, scratch, nested)
    check(spark, scratch, [(21, 0, "u", "x")] * 5 + [(22, 1, None, None), (None, 0, "u", "y"), (0, 3, "a", "b" * 5000)])
    check(spark, scratch, [(c, 0, "u", "x") for c in (1, 2, 3, 4, 5, 6, 7)])  # no base: some lose their only turn


def test_empty(spark, scratch):
    check(spark, scratch, [])
    check(spark, scratch, [(None, 1, "u", "t")])
