"""What is asked of outside services, and how pages and fallbacks follow one another (A1, A4, A6, A7, A9); the caller gives the fetcher."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .parsing import html_text

#: Words and characters above which a page's text counts as the article's.
LEAST_CHARS, LEAST_WORDS = 1000, 500


def esearch_term(query: Column, first: int | None = None, last: int | None = None) -> Column:
    """A1: the query, within the years of publication if they are given."""
    if first is None and last is None:
        return query
    low, high = first if first is not None else 1900, last if last is not None else 2100
    return F.concat(F.lit("("), query, F.lit(f") AND {low}:{high}[dp]"))


def esearch_request(query: Column, most: int = 100, first: int | None = None, last: int | None = None) -> Column:
    """A1: the parameters of a search for article ids."""
    return F.create_map(F.lit("db"), F.lit("pmc"), F.lit("term"), esearch_term(query, first, last), F.lit("retmax"), F.lit(str(most)), F.lit("retmode"), F.lit("json"))


def atom_request(query: Column, start: Column | int = 0, most: int = 100, sort: str = "submittedDate", order: str = "descending") -> Column:
    """A4: the parameters of one page of the preprint archive's feed."""
    start = F.lit(start) if isinstance(start, int) else start
    pairs = (("search_query", query), ("start", start.cast("string")), ("max_results", F.lit(str(most))), ("sortBy", F.lit(sort)), ("sortOrder", F.lit(order)))
    return F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)])


def page_starts(queries: DataFrame, limit: int, size: int = 100) -> DataFrame:
    """A row per page (query, page, start, size) of each query's first `limit` results; pages can be fetched side by side."""
    starts = F.sequence(F.lit(0), F.lit(max(0, limit - 1)), F.lit(size))
    pages = queries.select("*", F.posexplode(starts).alias("page", "start"))
    return pages.withColumn("size", F.least(F.lit(size), F.lit(limit) - F.col("start"))) if limit > 0 else pages.withColumn("size", F.lit(size)).limit(0)


def short_pages(queries: DataFrame, get: Callable[[str, int, int], str | None], count: Callable[[str], int], limit: int, size: int = 10) -> DataFrame:
    """Query, page, payload: each query's pages one after the other until one is short, missing or the limit is reached.

    `get(query, start, size)` fetches, `count(payload)` says how many results it holds. Queries run
    side by side, as many as `queries` has partitions. Null queries have no pages.
    """

    def pages(query: str) -> Iterator[tuple[str, int, str]]:
        for page, start in enumerate(range(0, limit, size)):
            payload = get(query, start, size)
            if payload is None:
                return
            yield query, page, payload
            if count(payload) < size:
                return

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([p for q in b["query"] if q is not None for p in pages(q)], columns=["query", "page", "payload"])

    return queries.select("query").mapInPandas(each, "query string, page int, payload string")


def full_texts(docs: DataFrame, html: Callable[[str], str | None], pdf: Callable[[str], str | None]) -> DataFrame:
    """Id, text, origin ("html", "pdf" or null), error of each document (id, html_url, pdf_url).

    The page's text is taken if it is long enough to be the article's, else the PDF's text that
    `pdf` gives; what either raises is the row's error unless the other has a text.
    """

    def one(html_url: str | None, pdf_url: str | None) -> tuple[str | None, str | None, str | None]:
        errors = []
        if html_url:
            try:
                text = html_text(html(html_url))[1]
                if len(text) > LEAST_CHARS and len(text.split()) > LEAST_WORDS:
                    return text, "html", None
            except Exception as e:  # whatever a fetcher raises is the row's error
                errors.append(f"{type(e).__name__}: {e}")
        if pdf_url:
            try:
                if text := (pdf(pdf_url) or "").strip():
                    return text, "pdf", None
            except Exception as e:
                errors.append(f"{type(e).__name__}: {e}")
        return None, None, "; ".join(errors) or "no full text"

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [one(h, p) for h, p in zip(b.html_url, b.pdf_url, strict=True)]
            yield pd.DataFrame({"id": b.id, "text": [t for t, _, _ in got], "origin": [o for _, o, _ in got], "error": [e for _, _, e in got]})

    return docs.select("id", "html_url", "pdf_url").mapInPandas(each, "id string, text string, origin string, error string")
