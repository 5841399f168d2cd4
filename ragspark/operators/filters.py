"""Metadata predicates (C1-C9): each is a Column, an empty list or None filters nothing."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Filters:
    authors: list[str] | None = None
    year_min: int | None = None
    year_max: int | None = None
    institutions: list[str] | None = None
    sources: list[str] | None = None
    doc_ids: list[int] | None = None


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def author(names: list[str], column: str = "author") -> Column:
    """Some author is like some name, ignoring case; % and _ are wildcards."""
    like = lambda n: lambda a: F.lower(a).like(f"%{n.lower()}%")
    return any_of(F.exists(column, like(n)) for n in names)


def institution(names: list[str], column: str = "institute") -> Column:
    return any_of(F.lower(F.col(column)).like(f"%{n.lower()}%") for n in names)


def years(low: int | None, high: int | None, column: str = "year") -> Column:
    """Inclusive; a null year fails."""
    if any(y is not None and not 1900 <= y <= 2100 for y in (low, high)):
        raise ValueError("a year is from 1900 to 2100")
    y, out = F.year(column), F.lit(True)
    if low is not None:
        out = out & (y >= low)
    if high is not None:
        out = out & (y <= high)
    return out


def build(f: Filters) -> Column:
    """The conjunction of the groups given."""
    parts = [F.lit(True)]
    if f.authors:
        parts.append(author(f.authors))
    if f.year_min is not None or f.year_max is not None:
        parts.append(years(f.year_min, f.year_max))
    if f.institutions:
        parts.append(institution(f.institutions))
    if f.sources:
        parts.append(F.col("source").isin(f.sources))
    if f.doc_ids:
        parts.append(F.col("doc_id").isin(f.doc_ids))
    return reduce(lambda a, b: a & b, parts)


def usable_text(column: str = "text", least: int = 100) -> Column:
    """C9."""
    return F.col(column).isNotNull() & (F.length(column) > least)
