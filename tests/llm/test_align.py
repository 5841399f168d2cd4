"""The alignment against plain code on the tokenizers themselves, over runs cut small, and on hostile texts."""

import collections
import hashlib

import pyarrow as pa
import pytest

from ragspark.llm import align


@pytest.fixture(scope="module")
def tools():
    return align.Tools(align.Settings())


def plain_tokens(text, tools):
    """(ids, bytes) of both sides by the tokenizers alone; None if one does not spell the text."""
    if not text:
        return None
    letters = align.byte_letters()
    a = tools.a.tokenizer.encode(" " + text, add_special_tokens=False)
    a_bytes = [bytes(letters[c] for c in t) for t in a.tokens]
    b = tools.b.model.encode(text)
    pieces = [tools.b.model.id_to_piece(i) for i in b]
    b_bytes = [bytes([int(p[3:5], 16)]) if tools.b.model.is_byte(i) else p.replace("▁", " ").encode() for p, i in zip(pieces, b)]
    want = (" " + text).encode()
    return None if b"".join(a_bytes) != want or b"".join(b_bytes) != want else ((a.ids, a_bytes), (b, b_bytes))


def brute(texts, tools):
    out, counts = [], collections.Counter()
    for text in texts:
        tokens = plain_tokens(text, tools)
        if tokens is None:
            out.append((0, 0, [], []))
            continue
        ends = []
        for ids, spelt in tokens:
            at, side = 0, {}
            for i, s in zip(ids, spelt):
                at += len(s)
                side[at] = i
            ends.append(side)
        groups, links = [([], [])], []
        for at in sorted({*ends[0], *ends[1]}):
            for side in (0, 1):
                if at in ends[side]:
                    groups[-1][side].append(ends[side][at])
            if at in ends[0] and at in ends[1]:
                links.append((ends[0][at], ends[1][at]))
                groups.append(([], []))
        counts.update(links)
        out.append((len(ends[0]), len(ends[1]), groups[:-1], links))
    top = collections.Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    rows = []
    for n_a, n_b, groups, links in out:
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        rows.append((n_a, n_b, len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return rows


TEXTS = ["Hello world, it's 2024 and we don't stop.", "Étion dans çouelle\nun éonierç  le   ch", " leading and trailing  ", "a\tb\r\n c\n\n d", "x y 　z", "▁block here", "plain ▁ here", "<|endoftext|> and <s> <0x0A> </s> <unk>", "你好 世界 \U0001f600\U0001f600 mixed", "\0 nul \x1c sep", "é ① ﬁ", "a" * 700 + " " + "ab" * 400, "\n", " ", "   ", "word", "", None, "In nicht ü einachie. In nicht ü einachie."]


@pytest.mark.parametrize("run, held", [(align.RUN, align.HELD), (3, 8)])
def test_equals_plain_code(spark, scratch, tools, monkeypatch, run, held):
    """The small sizes cut every text into many runs and flushes; set where the tasks' functions read them."""
    texts = TEXTS + [" ".join(f"w{i * k % 17}.{k}" for i in range(60)) for k in range(1, 6)] + TEXTS[:2]
    rows = [(None if i == 3 else i % 20, t, 5, "c") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, a int, n string").repartition(3)
    if run == align.RUN:
        got = [tuple(r) for r in align.align(spark, df, scratch).collect()]
        assert sorted(map(str, got)) == sorted(str((r[0], *b)) for r, b in zip(rows, brute(texts, tools)))
        return
    monkeypatch.setattr(align, "RUN", run)
    monkeypatch.setattr(align, "HELD", held)
    machine, docs = align.Sweep(tools), []
    for i, (a, b) in enumerate(align.encode(pa.array(texts), tools)):
        d = align.Document(i, i)
        docs.append(d)
        for s in range(0, max(len(a), len(b)), run):  # runs of the two sides, in turn
            d.a += [a[s : s + run]] if s < len(a) else []
            d.b += [b[s : s + run]] if s < len(b) else []
            if s % 2:
                machine.work(docs, False)
                docs = docs[-1:]
        machine.work(docs, True)
        want = brute([texts[i]], tools)[0]
        assert (d.n_a, d.n_b, d.groups, d.digest.hexdigest() if d.digest else "") == (*want[:3], want[6])
        docs = []


def test_words_apart_and_together_give_the_same_ids(tools):
    import random

    rng = random.Random(4)
    letters = "abcdefghijklmnop'éüß.,;:!?-_()<>|0123456789\n\t\"/\\’中\U0001f600"
    texts = ["".join(rng.choice(letters + "   ") for _ in range(rng.randint(1, 120))) for _ in range(400)]
    for text, (a, b) in zip(texts, align.encode(pa.array(texts), tools)):
        tokens = plain_tokens(text, tools)
        assert ([], []) == (a.tolist(), b.tolist()) if tokens is None else (tokens[0][0], tokens[1][0]) == (a.tolist(), b.tolist())


def test_given_documents(spark, scratch, tools, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = df.select("doc_id", "text").collect()
    got = [tuple(r) for r in align.align(spark, df, scratch).collect()]
    assert sorted(got) == sorted((r.doc_id, *b) for r, b in zip(rows, brute([r.text for r in rows], tools)))


def test_empty(spark, scratch):
    assert align.align(spark, spark.createDataFrame([], "doc_id long, text string"), scratch).count() == 0
