"""Text of PDF files (A8), where a PDF library is installed; none is a requirement."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    from pypdf import PdfReader
except ImportError:
    PdfReader = None

PAGES = 30


def pdf_text(data: bytes, pages: int = PAGES) -> str:
    """The first pages' text (G17), parted by blank lines."""
    if PdfReader is None:
        raise RuntimeError("no PDF library is installed")
    return "\n\n".join(t for p in PdfReader(io.BytesIO(data)).pages[:pages] if (t := (p.extract_text() or "").strip()))


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text, error of each file; an unreadable one is a row with its error."""

    def one(data: bytes) -> tuple[str | None, str | None]:
        try:
            return pdf_text(data), None
        except Exception as e:  # whatever a broken file raises is the row's error
            return None, f"{type(e).__name__}: {e}"

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [one(c) for c in b.content]
            yield pd.DataFrame({"path": b.path, "text": [t for t, _ in got], "error": [e for _, e in got]})

    files = spark.read.format("binaryFile").load(path).select("path", F.col("content"))
    return files.mapInPandas(each, "path string, text string, error string")
