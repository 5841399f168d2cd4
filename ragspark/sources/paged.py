"""Paged services as a data source (A1, A4, A6, A9, K4): spark.read.format("paged_search"), or readStream from page to page.

Options: queries (a JSON list of texts), fetcher ("module:Class"), fetcher_options (JSON, given to
the class), limit (results a query), page_size, pages_a_task, rate (requests a second, of all tasks
together), retries. A fetcher has page(query, start, size), a list of texts, and total(query), a
number or None. Rows: query, page, position (from 0 in the query), payload.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "query string, page int, position long, payload string"


class NumberedFetcher:
    """An offline stand-in: each query has `totals[query]` (or `total`) results, which are its text and a number."""

    def __init__(self, totals: dict[str, int] | None = None, total: int = 0):
        self.totals, self.default = totals or {}, total

    def total(self, query: str) -> int | None:
        return self.totals.get(query, self.default)

    def page(self, query: str, start: int, size: int) -> list[str]:
        return [f"{query}#{i}" for i in range(start, min(start + size, self.total(query)))]


@dataclass
class Pages(InputPartition):
    """Consecutive pages of one query, and when the first may be asked for."""

    query: str
    first: int
    count: int
    not_before: float
    apart: float


class _Service:
    """What both readers share: the options, the fetcher, the way to read a run of pages."""

    def __init__(self, options: dict):
        get = {k.lower(): v for k, v in options.items()}.get
        self.queries = [q for q in json.loads(get("queries", "[]")) if q is not None]
        self.limit, self.size = int(get("limit", "100")), int(get("page_size", "100"))
        self.a_task, self.rate, self.retries = int(get("pages_a_task", "1")), float(get("rate", "0")), int(get("retries", "3"))
        if self.size < 1 or self.a_task < 1:
            raise ValueError("page_size and pages_a_task are 1 at least")
        module, _, name = get("fetcher", f"{__name__}:NumberedFetcher").partition(":")
        self.fetcher = getattr(importlib.import_module(module), name)(**json.loads(get("fetcher_options", "{}")))

    def pages_of(self, query: str) -> int:
        """How many pages the query may have: by its total if the service tells it, else by the limit."""
        total = self.fetcher.total(query)
        return -(-max(0, self.limit if total is None else min(total, self.limit)) // self.size)

    def runs(self, spans: list[tuple[str, int, int]]) -> list[Pages]:
        """Partitions of (query, first page, end): a page's number in the whole plan gives its time slot, so tasks need no word of each other."""
        out, slot, now = [], 0, time.time()
        for query, first, end in spans:
            for p in range(first, end, self.a_task):
                n = min(self.a_task, end - p)
                out.append(Pages(query, p, n, now + (slot / self.rate if self.rate else 0), 1 / self.rate if self.rate else 0))
                slot += n
        return out

    def rows(self, run: Pages) -> Iterator[tuple[str, int, int, str]]:
        """The run's pages in order, to a short one; a request that fails is made again, later each time, then fails the task."""
        for i in range(run.count):
            start = (run.first + i) * self.size
            size = min(self.size, self.limit - start)
            time.sleep(max(0.0, run.not_before + i * run.apart - time.time()))
            got = self._page(run.query, start, size)
            for j, payload in enumerate(got[:size]):
                yield run.query, run.first + i, start + j, payload
            if len(got) < size:
                return

    def _page(self, query: str, start: int, size: int) -> list[str]:
        for attempt in range(self.retries + 1):
            try:
                return list(self.fetcher.page(query, start, size) or [])
            except Exception:
                if attempt == self.retries:
                    raise
                time.sleep(min(30.0, 0.1 * 2**attempt))
        return []


class PagedReader(DataSourceReader):
    """A partition a run of pages; a task that is lost asks for its own pages again."""

    def __init__(self, options: dict):
        self.service = _Service(options)

    def partitions(self) -> list[Pages]:
        return self.service.runs([(q, 0, self.service.pages_of(q)) for q in self.service.queries])

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.service.rows(partition)


class PagedStreamReader(DataSourceStreamReader):
    """Pages a batch: an offset is the number of pages done of each query, so a restart goes on behind the last committed batch.

    New results are new pages: each batch asks for the totals anew. The last page of a query is read
    once it is full, or when the limit is reached.
    """

    def __init__(self, options: dict):
        self.options = options
        self.service = _Service(options)
        self.a_batch = int({k.lower(): v for k, v in options.items()}.get("pages_a_batch", "10"))
        self.at: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {q: 0 for q in self.service.queries}

    def latestOffset(self) -> dict:
        out = {}
        for q in self.service.queries:
            total = self.service.fetcher.total(q)
            whole = self.service.pages_of(q) if total is None or total >= self.service.limit else total // self.service.size
            self.at[q] = out[q] = max(self.at.get(q, 0), min(whole, self.at.get(q, 0) + self.a_batch))
        return out

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        self.at |= {q: max(n, self.at.get(q, 0)) for q, n in end.items()}
        return self.service.runs([(q, start.get(q, 0), n) for q, n in end.items() if n > start.get(q, 0)])

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.service.rows(partition)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))

    def streamReader(self, schema) -> PagedStreamReader:
        return PagedStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)
