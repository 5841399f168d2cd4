"""Words of plain letters give the same ids by both engines; other words and vocabularies are left to the tokenizer."""

import random

import numpy as np
import public_tokenizers
import pytest

from ragspark.llm import packing
from ragspark.llm.word_bpe import WordBpe


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(packing.default_tokenizer())


def test_same_ids(spark, encoder, sf_dir):
    rng = random.Random(1)
    words = {w for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect() for w in (r.text or "").split()}
    words |= {"".join(rng.choice("abcdefghijklmnopqrstuvwxyzßàéèüöñÿçÉÜ") for _ in range(rng.randint(1, 14))) + rng.choice(["", ".", ",", "?!", ";:"]) for _ in range(5000)}
    words |= {"don't", "x9", "a.b", ".", "é", "é", "µ", "÷", "中", "İ", "ß" * 90, "z" * 3000, "<|endoftext|>", ""}
    words = sorted(words)
    sizes, ids = encoder.tokenized(words)
    want = encoder.by_tokenizer(words)
    assert np.array_equal(sizes, want[0]) and np.array_equal(ids, want[1])
    alone = [encoder.tokenizer.encode(w, add_special_tokens=False).ids for w in words if "<|" not in w]
    begin = np.cumsum(sizes) - sizes
    assert alone == [ids[b : b + n].tolist() for w, b, n in zip(words, begin, sizes) if "<|" not in w]


def test_other_vocabularies_are_none():
    assert WordBpe.of(public_tokenizers.path("byte_bpe_50k.json")) is None
    assert WordBpe.of(packing.default_tokenizer()) is not None
