"""What can be plugged in (2.L): an embedder, an entity extractor, a generator; with offline defaults that always give the same."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType


class Embedder(Protocol):
    name: str
    dim: int

    def encode(self, texts: Sequence[str]) -> np.ndarray: ...


class EntityExtractor(Protocol):
    """(text, label, start, end) of each entity; the label is one of ours or a model's (ner.MODEL_LABELS)."""

    def extract(self, text: str) -> list[tuple[str, str, int, int]]: ...


class Generator(Protocol):
    def generate(self, system: str, user: str) -> str: ...


class HashEmbedder:
    """Signed hashes of words and word pairs, normalised."""

    def __init__(self, dim: int = 384):
        self.name, self.dim = f"hash-{dim}", dim

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            words = re.findall(r"\w+", (t or "").lower())
            for g in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]:
                h = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class ExtractiveGenerator:
    """Answers with the first sentence of the first passages, cited."""

    def generate(self, system: str, user: str) -> str:
        blocks = re.findall(r"\[([^\]#]+)#(\d+)\] (.+)", user)
        return " ".join(f"{text.split('. ')[0].strip('. ')}. [{doc}#{idx}]" for doc, idx, text in blocks[:3]) or "The passages do not answer this."


def embed(df: DataFrame, embedder: Embedder, text: str = "text", out: str = "embedding") -> DataFrame:
    """`df` with an embedding; the embedder goes to each worker once, texts come in batches."""
    schema = StructType([*df.schema.fields, StructField(out, ArrayType(DoubleType()))])

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{out: list(embedder.encode(b[text].tolist()))})

    return df.mapInPandas(each, schema).withColumn(out, F.transform(out, lambda x: F.round(x, 6).cast("float")))


#: The prompts; only the form of a citation matters to what reads the answer.
SYSTEM_PROMPT = """You answer questions about biomedical articles from the passages given, and from nothing else.
Put the passage's reference, as [PMCID:chunk], behind every statement. Say so when the passages do not hold the answer.
Keep to short, factual sentences."""
USER_PROMPT = """Passages:
{context}

Question: {question}

Cite as [PMCID:chunk]."""


def prompt_context(hits: DataFrame) -> DataFrame:
    """One string of the hits, `[doc#idx] text`, in order of rank."""
    line = F.concat(F.lit("["), "doc_ref", F.lit("#"), F.col("chunk_index").cast("string"), F.lit("] "), "text")
    return hits.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("context"))
