"""The pipeline's stages one after the other, each held against plain code on its own input."""

import re
import zlib

import corpus_pipeline
import pytest

from ragspark.llm import queries, secrets
from ragspark.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    s = Scratch(spark, "pipe")
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (name, f) in enumerate(corpus_pipeline.STAGES):
        after = s.save(f(spark, docs, sf_dir), str(i))
        out.append((name, docs.collect(), after.collect(), after.columns))
        docs = after
    return out


def test_columns(stages):
    assert [n for n, *_ in stages] == ["language", "near_duplicates", "secrets", "mixing", "packing"]
    assert all(c == corpus_pipeline.COLUMNS for *_, c in stages[:-1])


def test_language(stages):
    _, before, after, _ = stages[0]
    told = {r.doc_id: r.lang for r in before}
    assert all(r.lang == told[r.doc_id] if told[r.doc_id] else r.lang for r in after)
    assert {r.doc_id for r in after} == {r.doc_id for r in before if r.text and re.search(r"[^\W\d_]", r.text)}


def test_near_duplicates(stages):
    _, before, after, _ = stages[1]
    low = str.maketrans({i: i + 32 for i in range(65, 91)})
    sets = {}
    for r in before:
        w = WORD.findall(r.text.translate(low))
        sets[r.doc_id] = {tuple(w)} if len(w) < 3 else {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    order = sorted(sets)
    for k, i in enumerate(order):
        for j in order[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 90 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert {r.doc_id for r in after} == {i for i in sets if root(i) == i}
    assert len(after) < len(before)


def test_secrets(stages):
    _, before, after, _ = stages[2]
    text = {r.doc_id: r.text for r in after}
    assert text == {r.doc_id: secrets.redact(r.text) for r in before}
    assert all(r.n_chars == len(r.text) for r in after if r.text != next(b.text for b in before if b.doc_id == r.doc_id))


def test_mixing(stages):
    _, before, after, _ = stages[3]
    sizes: dict = {}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text))
    taken = sum(len(WORD.findall(r.text)) for r in after)
    assert taken == pytest.approx(1.5 * sum(sizes.values()), rel=0.1)
    seen: dict = {}
    for r in after:
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert max(seen.values()) <= 2


def test_packing(stages):
    _, before, after, _ = stages[4]
    from tokenizers import Tokenizer

    from ragspark.llm import packing

    t = Tokenizer.from_file(packing.default_tokenizer())
    want = sum(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in before)
    assert sum(r.length for r in after) == want
    copies: dict = {}
    for r in before:
        ids = [*t.encode(r.text, add_special_tokens=False).ids, 1]
        copies.setdefault((r.doc_id, len(ids)), [ids, 0])[1] += 1
    for (doc, n), (ids, times) in copies.items():
        mine = [r for r in after if r.doc_id == doc and r.doc_tokens == n]
        assert sum(r.length for r in mine) == n * times
        assert all(r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[r.start : r.start + r.length])) for r in mine)


def test_run_is_the_stages(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    whole = lambda rows: sorted((r.doc_id, r.doc_tokens, sum(x.length for x in rows if x.doc_id == r.doc_id)) for r in rows if r.start == 0)
    assert whole(got) == whole(stages[-1][2])


def test_null_languages_are_predicted(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    blank = d.selectExpr("doc_id", "text", "if(doc_id % 5 = 0, null, lang) as lang", "source", "n_chars")
    got = corpus_pipeline.language(spark, blank, sf_dir).filter("doc_id % 5 = 0").join(d.selectExpr("doc_id", "lang as told"), "doc_id").collect()
    assert got and all(r.lang for r in got) and sum(r.lang == r.told for r in got) >= 0.9 * len(got)


def test_odd_rows(spark, docs, sf_dir):
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, "12 34", "en", "a"), (4, "One two three four", None, None), (4, "One two three four", None, None), (None, "one TWO three four", "en", "b"), (None, "alone in the world", None, "b"), (5, "token=abcdef123 and more words", "en", None), (6, "the of and " * 20_000, "en", "a"), (7, "one two three four", "en", "c")]
    d = docs(rows)
    out = []
    for _, f in corpus_pipeline.STAGES:
        after = Scratch(spark, "odd").save(f(spark, d, sf_dir), "x")
        out.append(after.collect())
        d = after
    assert len(out[0]) == 7 and {r.doc_id for r in out[1]} == {4, None, 5, 6} and len(out[1]) == 4
    assert [r.text for r in out[2] if r.doc_id == 5] == ["[REDACTED] and more words"]
    assert {r.doc_id for r in out[3]} <= {4, None, 5, 6} and out[4]
    empty = docs([])
    for _, f in corpus_pipeline.STAGES:
        empty = Scratch(spark, "none").save(f(spark, empty, sf_dir), "x")
        assert empty.count() == 0


def test_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in queries.queries()}
    assert set(queries.queries()) | {"pipeline"} <= names
