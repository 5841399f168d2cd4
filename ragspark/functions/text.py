"""Text expressions: tokens, sentences, windows of tokens, match and rank, highlighting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def split_words(text: Column) -> Column:
    """Words between white space; [] for blank text."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def token_count(text: Column) -> Column:
    """I15."""
    return F.size(split_words(F.coalesce(text, F.lit("")))).cast("long")


def terms(text: Column) -> Column:
    """Lower-case runs of a-z: the words that match and rank."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+"), lambda w: w != "")


def query_terms(query: str, most: int = 10) -> list[str]:
    """The terms of the first `most` words, in order, each once. Punctuation cannot break the query."""
    import re

    found = [t for w in query.split()[:most] for t in re.split("[^a-z]+", w.lower()) if t]
    return list(dict.fromkeys(found))


def matches(words: Column, query: list[str], mode: str = "and") -> Column:
    """All (or any) of the query's terms are among the words; an empty query matches nothing."""
    if not query:
        return F.lit(False)
    if mode == "or":
        return F.arrays_overlap(words, F.lit(query))
    return F.size(F.array_except(F.lit(query), words)) == 0


def term_score(words: Column, query: list[str]) -> Column:
    """How large a part of the words the query's terms are."""
    hits = F.size(F.filter(words, lambda w: w.isin(query))) if query else F.lit(0)
    return F.coalesce(F.try_divide(hits.cast("double"), F.size(words)), F.lit(0.0))


def sentences(text: Column) -> Column:
    """Cut at white space between a stop and an upper-case letter, digit or bracket; line breaks are spaces first."""
    flat = F.regexp_replace(strip(F.coalesce(text, F.lit(""))), r"\n+", " ")
    return F.filter(F.transform(F.split(flat, r"(?<=[.?!])\s+(?=[A-Z0-9(])"), strip), lambda s: s != "")


def chunk_by_tokens(text: Column, size: int = 600, overlap: int = 90) -> Column:
    """Windows of `size` words, each `overlap` into the one before."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    words = split_words(F.coalesce(text, F.lit("")))
    n = F.size(words)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, F.lit(size)), " "))


def preview(text: Column, n: int = 500) -> Column:
    """I12."""
    return F.substring(text, 1, n)


def content_hash(text: Column) -> Column:
    """I11."""
    return F.sha2(text, 256)


#: Words that are not highlighted.
DULL = ("what", "are", "the", "is", "in", "of", "and", "or", "for", "with", "to", "a", "an")


def highlight(text: Column, query: str, open_: str = "<mark>", close: str = "</mark>") -> Column:
    """Words that begin with a keyword (over three letters, not dull) are wrapped, whatever their case."""
    import re

    words = [w.lower() for w in query.split()]
    keys = [k for k in dict.fromkeys(re.sub(r"[^\w]", "", w) for w in words if len(w) > 3 and w not in DULL) if k]
    return reduce(lambda t, k: F.regexp_replace(t, rf"(?i)\b({k}\w*)\b", f"{open_}$1{close}"), keys, text)


def synthesized_query(text: Column, n: int = 150) -> Column:
    """The first sentence of a preview as a question."""
    return F.concat(F.element_at(F.split(F.substring(text, 1, n), r"\."), 1), F.lit("."))


def char_budget(length: Column, running: Column, budget: int) -> Column:
    """how many characters of a block fit, given the running sum that includes it."""
    return F.greatest(F.lit(0), F.least(length, F.lit(budget) - (running - length)))


def ordered_distinct(items: Column) -> Column:
    """First of each, ignoring case and outer spaces; blanks go."""
    clean = F.filter(F.transform(items, strip), lambda x: x != "")
    return F.aggregate(clean, F.array().cast("array<string>"), lambda got, x: F.when(F.exists(got, lambda g: F.lower(g) == F.lower(x)), got).otherwise(F.array_append(got, x)))
