"""Identifiers, citations, years, authors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ordered_distinct, strip


def _blank_null(c: Column) -> Column:
    return F.when(c != "", c)


def doc_ref(ext_id: Column) -> Column:
    """C11: the identifier behind its namespace; upper case for pmcid only; UNKNOWN for null."""
    tail = F.regexp_replace(ext_id, r"^(pmcid|arxiv|scholar)://", "")
    return F.coalesce(F.when(ext_id.startswith("pmcid://"), F.upper(tail)).otherwise(tail), F.lit("UNKNOWN"))


def arxiv_id(x: Column) -> Column:
    """I27."""
    return F.regexp_replace(F.regexp_replace(strip(x), r"(?i)^arxiv:", ""), r"v[0-9]+$", "")


def doi(x: Column) -> Column:
    """I28."""
    return F.lower(F.regexp_replace(strip(x), r"(?i)^https?://(dx\.)?doi\.org/", ""))


def arxiv_doi(x: Column) -> Column:
    """I29."""
    return F.concat(F.lit("10.48550/arXiv."), arxiv_id(x))


def find_doi(text: Column) -> Column:
    """The first DOI in a text, in its normal form."""
    return doi(_blank_null(F.regexp_extract(text, r"\b(10\.[0-9]{4,9}/\S+)\b", 1)))


def entry_doi(doi_field: Column, doi_link: Column, journal_ref: Column, raw_id: Column) -> Column:
    """Of an arXiv entry, its DOI field, its DOI link, one in the journal reference, else the archive's own."""
    return F.coalesce(doi(_blank_null(doi_field)), doi(_blank_null(doi_link)), find_doi(journal_ref), arxiv_doi(raw_id))


def pmcid(x: Column, lookup: Column | None = None) -> Column:
    """A10: itself in upper case if it is one, else what a lookup gave."""
    up = F.upper(strip(x))
    return F.when(up.startswith("PMC"), up).otherwise(lookup if lookup is not None else F.lit(None).cast("string"))


def scholar_id(result_id: Column, title: Column) -> Column:
    """I32."""
    return F.coalesce(_blank_null(result_id), F.substring(F.md5(title), 1, 16))


def uri(x: Column) -> Column:
    """I33."""
    return F.lower(F.regexp_replace(strip(x), "/+$", ""))


def year_of(text: Column) -> Column:
    """The first year from 1900 to 2099, as January 1st."""
    y = F.regexp_extract(text, r"\b((19|20)[0-9]{2})\b", 1)
    return F.when(y != "", F.make_date(y.try_cast("int"), F.lit(1), F.lit(1)))


def authors(text: Column) -> Column:
    """`A; B;; C` to [A, B, C]; null if nothing is left."""
    got = F.filter(F.transform(F.split(text, ";"), strip), lambda a: a != "")
    return F.when(F.size(got) > 0, got)


def norm_authors(text: Column) -> Column:
    """Authors parted by commas, semicolons or line breaks, each once."""
    return ordered_distinct(F.split(text, r"[;,\n]+"))


# Filters that only the other search engine knows.
OPEN_ACCESS = r'(?i)\(\s*"open access"\s*\[filter\]\s*\)'
DATE_RANGE = r"(?i)\(\s*[0-9]{4}\s*:\s*[0-9]{4}\s*\[dp\]\s*\)"


def sanitize_arxiv_query(q: Column) -> Column:
    """Without those filters; each word or quoted phrase in quotes under all:, AND, OR and brackets as they are."""
    bare = F.regexp_replace(F.regexp_replace(q, OPEN_ACCESS, ""), DATE_RANGE, "")
    bare = strip(F.regexp_replace(bare, r"\s+", " "))
    return F.regexp_replace(bare, r'"([^"]*)"|(?<![^\s()"])(?!(?:AND|OR)(?![^\s()"]))([^\s()"]+)', 'all:"$1$2"')


def citations(text: Column) -> Column:
    """(doc, idx) of each bracket that names a PMC document and a chunk; ordered, each once."""
    groups = F.regexp_extract_all(text, F.lit(r"\[([^\[\]]+)\]"), 1)
    pairs = F.transform(
        groups,
        lambda g: F.struct(
            F.upper(F.regexp_extract(g, r"(?i)(PMC[0-9]+)", 1)).alias("doc"),
            F.regexp_extract(g, r"[#:]\s*([0-9]+)", 1).try_cast("int").alias("idx"),
        ),
    )
    return F.array_distinct(F.filter(pairs, lambda p: (p["doc"] != "") & p["idx"].isNotNull()))


def assigned(user: Column, n: int) -> Column:
    """The 128 bits of the user's MD5, as a number, mod n: Horner's rule over hex digits."""
    digits = F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.conv(F.substring(F.md5(user), i, F.lit(1)), 16, 10).cast("long"))
    return F.aggregate(digits, F.lit(0).cast("long"), lambda a, x: (a * 16 + x) % n)
