"""The vocabulary's automaton against one pattern of all terms, a large one, and the contexts' sentences."""

import random
import re
import time

import pytest

from ragspark.operators import ner


def by_pattern(terms, text):
    """Longest first, at word edges, whatever the case."""
    listed = sorted(terms, key=lambda t: (-len(t), t))
    p = re.compile(r"\b(?:" + "|".join(map(re.escape, listed)) + r")\b", re.IGNORECASE)
    low = {t.lower(): v for t, v in terms.items()}
    return [(m.start(), m.end(), low[m[0].lower()]) for m in p.finditer(text)]


@pytest.mark.parametrize("seed", range(5))
def test_same_as_a_pattern(seed):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice("abAB -é(1") for _ in range(n))
    terms = {t: rng.choice("xy") for t in (make(rng.randint(1, 6)).lower() for _ in range(60)) if t.strip()}
    for _ in range(200):
        text = make(rng.randint(0, 40))
        assert ner.Vocabulary(terms).find(text) == by_pattern(terms, text), text


def test_many_terms_in_one_pass(spark):
    rng = random.Random(9)
    terms = {f"t{i} u{i % 7}": "DRUG" for i in range(100_000)}
    text = " ".join(f"t{rng.randrange(200_000)} u{rng.randrange(7)}" for _ in range(5_000))
    known = ner.Vocabulary(terms)
    began = time.perf_counter()
    got = known.find(text)
    assert time.perf_counter() - began < 5
    want = [(m.start(), m.end(), "drug") for m in re.finditer(r"t\d+ u\d", text) if m[0] in terms]
    assert got == want and got
    df = spark.createDataFrame([(1, "s", 0, text), (2, None, 1, None)], "doc_id long, section_name string, chunk_index int, text string")
    assert ner.extract_mentions(df, known).filter("label = 'drug'").count() == len(want)


def test_odd_terms_and_bounds(monkeypatch):
    assert ner.Vocabulary({}).find("x") == [] and ner.Vocabulary({" ": "a", "": "b"}).find("x y") == []
    assert ner.Vocabulary({"ab": "x"}).find("İ AB") == [(2, 4, "x")]
    monkeypatch.setattr(ner, "MOST_TERMS", 1)
    with pytest.raises(ValueError, match="at most"):
        ner.Vocabulary({"a": "x", "b": "y"})


def test_contexts():
    s = ner.Sentences("One is here. Two CT scans.  Three")
    assert s.context(0, 3) == "One is here." and s.context(17, 19) == "Two CT scans." and s.context(28, 33) == "Three"
    assert s.context(10, 20).startswith("One") and ner.Sentences("").context(0, 0) == ""
    long = "A b. " * 20_000 + "CT"
    began = time.perf_counter()
    assert len(ner.entities(long + " CT" * 20_000)) == 20_001
    assert time.perf_counter() - began < 10


def test_contexts_are_handed_on_in_parts(spark, monkeypatch):
    """A text without stops is the context of each of its mentions: all of them together would be its square."""
    taken = {}
    df = spark.createDataFrame([(1, "s", 0, "x")], "doc_id long, section_name string, chunk_index int, text string")
    monkeypatch.setattr(type(df), "mapInPandas", lambda df, each, schema: taken.update(each=each))
    ner.extract_mentions(df)
    batch = ner.pd.DataFrame({"doc_id": [1], "section_name": ["s"], "chunk_index": [0], "text": ["CT " * 20_000]})
    rows = [len(frame) for frame in taken["each"](iter([batch]))]
    assert sum(rows) == 20_000 and max(rows) <= ner.HELD_CHARACTERS // 59_999 + 1


def test_without_contexts_the_rest_is_the_same(spark):
    df = spark.createDataFrame([(1, "s", 0, "A CT scan. License!"), (2, None, 1, None)], "doc_id long, section_name string, chunk_index int, text string")
    whole, less = (ner.extract_mentions(df, {"license": "DRUG"}, contexts=c) for c in (True, False))
    assert sorted(whole.drop("context").collect()) == sorted(less.drop("context").collect()) and whole.count() == 2
    assert {r.context for r in less.collect()} == {None} and None not in {r.context for r in whole.collect()}


def test_patterns_with_a_look_ahead_find_the_same():
    rng = random.Random(3)
    parts = ["p", "P-value", " ", "<", "=", "0.05", ".01", "95%", "CI", "ci:", "[1.2, 3]", "Significant", "\u017fignificant", "difference", "statistically", "x-RAY", "MRI", "stents", "medical", "device", "insulin  pump", "hearing aid", "wheelchair", "a", "_"]
    for _ in range(3_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        for ahead, patterns in ((ner.STATISTICS, ner.STATISTICS_PATTERNS), (ner.DEVICES, ner.DEVICE_PATTERNS)):
            plain = re.compile("|".join(patterns), re.IGNORECASE)
            assert [m.span() for m in ahead.finditer(text)] == [m.span() for m in plain.finditer(text)], text
