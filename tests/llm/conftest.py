import pytest

from ragspark.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


@pytest.fixture
def docs(spark):
    """Makes a documents table of (doc_id, text[, lang, source]); with a column that clashes with names used inside."""

    def make(rows):
        full = [(r[0], r[1], *(r[2:] or ("en", "s")), None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS).selectExpr("*", "'x' as chunk", "1 as size", "2.5 as score", "'k' as set_key", "0 as _rank", "'b' as block")

    return make
