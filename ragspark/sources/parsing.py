"""Parsers of fetched payloads (A1, A5, A7, A9-A12, A20, A21, I21-I25): DataFrames of raw text in, rows out."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import arxiv_id, entry_doi, norm_authors, scholar_id, year_of
from ..functions.text import ordered_distinct, strip

PASSAGE = "struct<text:string, infons:map<string,string>>"
DOCUMENT = f"struct<id:string, infons:map<string,string>, passages:array<{PASSAGE}>>"


def lenient_json(payload: Column, schema: str) -> Column:
    """JSON whatever it was sent as: where the whole is none, what lies between the outermost brackets."""
    inner = F.regexp_extract(payload, r"(?s)[\[{].*[\]}]", 0)
    broken = F.from_json(payload, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    empty = F.to_json(broken) == "{}"
    return F.when(~empty, broken).otherwise(F.from_json(F.when(inner != "", inner), schema))


def bioc_documents(payload: Column) -> Column:
    """The documents of {documents}, {collection: {documents}} or a list; else []."""
    docs = F.from_json(payload, f"documents array<{DOCUMENT}>")["documents"]
    inner = F.from_json(payload, f"collection struct<documents:array<{DOCUMENT}>>")["collection"]["documents"]
    listed = F.when(F.substring(strip(payload), 1, 1) == "[", F.from_json(payload, f"array<{DOCUMENT}>"))
    return F.coalesce(docs, inner, listed, F.array().cast(f"array<{DOCUMENT}>"))


def bioc_counts(payloads: DataFrame) -> DataFrame:
    """Documents and passages of each payload."""
    d = payloads.withColumn("_d", bioc_documents(F.col("payload")))
    passages = F.aggregate("_d", F.lit(0), lambda n, x: n + F.coalesce(F.array_size(x["passages"]), F.lit(0)))
    return d.select("id", F.size("_d").alias("documents"), passages.alias("passages"))


# Where BioC keeps authors, and the types of passages.
DOCUMENT_AUTHOR_KEYS = ("authors", "author", "creator", "contrib")
PASSAGE_AUTHOR_KEYS = ("authors", "author", "name", "contrib", "contributor")
TITLE_TYPES = ("title", "article-title")
HEADING_TYPES = ("section", "sec", "heading")
AFFILIATION_TYPES = ("affiliation", "author-affiliation")


def _passages(payload: Column) -> Column:
    return F.flatten(F.transform(bioc_documents(payload), lambda d: F.coalesce(d["passages"], F.array().cast(f"array<{PASSAGE}>"))))


def bioc_blocks(payloads: DataFrame, most: int = 8) -> DataFrame:
    """Id, ordinal, kind, text of the first `most` passages that have text and are not affiliations."""

    def kind(p: Column) -> Column:
        return F.lower(F.coalesce(F.when(p["infons"]["type"] != "", p["infons"]["type"]), p["infons"]["section_type"], F.lit("")))

    used = F.filter(_passages(F.col("payload")), lambda p: (strip(F.coalesce(p["text"], F.lit(""))) != "") & ~kind(p).isin(*AFFILIATION_TYPES))
    rows = payloads.select("id", F.posexplode(F.slice(used, 1, most)).alias("ordinal", "p"))
    named = F.when(kind(F.col("p")).isin(*TITLE_TYPES), "title").when(kind(F.col("p")).isin(*HEADING_TYPES), "heading").otherwise("para")
    return rows.select("id", "ordinal", named.alias("kind"), strip(F.col("p.text")).alias("text"))


def bioc_meta(payloads: DataFrame) -> DataFrame:
    """Id, title, year, institutes (joined), authors; each the first that any passage gives, institutes and authors all."""
    p = payloads.select("id", bioc_documents(F.col("payload")).alias("d"), _passages(F.col("payload")).alias("p"))

    def infon(k: str):
        return lambda x: x["infons"][k]

    text = lambda x: strip(F.coalesce(x["text"], F.lit("")))
    kind = lambda x: F.lower(F.coalesce(x["infons"]["type"], F.lit("")))
    titles = F.filter("p", lambda x: (kind(x).isin(*TITLE_TYPES) | F.coalesce(x["infons"]["section_type"] == "TITLE", F.lit(False))) & (text(x) != ""))
    dated = F.transform("p", lambda x: F.coalesce(year_of(F.coalesce(F.when(x["infons"]["year"] != "", x["infons"]["year"]), x["infons"]["date"])), year_of(x["text"])))
    places = F.transform(F.filter("p", lambda x: kind(x).isin("aff", *AFFILIATION_TYPES)), text)
    said = [F.transform("d", infon(k)) for k in DOCUMENT_AUTHOR_KEYS] + [F.transform("p", infon(k)) for k in PASSAGE_AUTHOR_KEYS]
    first = lambda x: F.coalesce(x["infons"]["given-names"], x["infons"]["firstname"])
    last = lambda x: F.coalesce(x["infons"]["surname"], x["infons"]["lastname"])
    said.append(F.transform("p", lambda x: F.concat_ws(" ", first(x), last(x))))
    joined = F.array_join(F.filter(F.concat(*said), lambda x: x.isNotNull()), ";")
    authors, institutes = norm_authors(joined), ordered_distinct(places)
    return p.select(
        "id",
        F.get(F.transform(titles, text), F.lit(0)).alias("title"),
        F.get(F.filter(dated, lambda y: y.isNotNull()), F.lit(0)).alias("year"),
        F.when(F.size(institutes) > 0, F.array_join(institutes, "; ")).alias("institutes"),
        F.when(F.size(authors) > 0, authors).alias("authors"),
    )


def esearch_ids(payload: Column) -> Column:
    """A1: PMC and the id of each hit."""
    ids = F.from_json(payload, "esearchresult struct<idlist:array<string>>")["esearchresult"]["idlist"]
    return F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda i: F.concat(F.lit("PMC"), i))


def idconv_pmcid(payload: Column) -> Column:
    """A10: what the converter says."""
    return F.get(F.from_json(payload, "records array<struct<pmcid:string>>")["records"], F.lit(0))["pmcid"]


def journal_doi(crossref: Column, datacite: Column) -> Column:
    """Is-preprint-of, then has-version, then DataCite's relations that are DOIs."""
    rel = F.from_json(crossref, "message struct<relation:map<string,array<struct<DOI:string>>>>")["message"]["relation"]
    related = F.from_json(datacite, "data struct<attributes:struct<relatedIdentifiers:array<struct<relationType:string,relatedIdentifier:string>>>>")["data"]["attributes"]["relatedIdentifiers"]
    hits = F.filter(related, lambda r: F.lower(r["relationType"]).isin("ispreprintof", "isversionof") & r["relatedIdentifier"].startswith("10."))
    return F.lower(F.coalesce(F.get(rel["is-preprint-of"], F.lit(0))["DOI"], F.get(rel["has-version"], F.lit(0))["DOI"], F.get(hits, F.lit(0))["relatedIdentifier"]))


def scholar_results(payloads: DataFrame, most: int | None = None) -> DataFrame:
    """A row per organic result: id, title, snippet, link, authors, year, pdf."""
    schema = "organic_results array<struct<result_id:string, title:string, snippet:string, link:string, publication_info:struct<authors:array<struct<name:string>>, summary:string>, resources:array<struct<file_format:string, link:string>>>>"
    found = F.from_json("payload", schema)["organic_results"]
    r = payloads.select("page", F.posexplode(found).alias("position", "r"))
    r = r.select(
        "page",
        "position",
        scholar_id(F.col("r.result_id"), F.col("r.title")).alias("scholar_id"),
        "r.title",
        "r.snippet",
        "r.link",
        ordered_distinct(F.transform("r.publication_info.authors", lambda a: a["name"])).alias("authors"),
        year_of(F.col("r.publication_info.summary")).alias("year"),
        F.get(F.filter("r.resources", lambda x: F.upper(x["file_format"]) == "PDF"), F.lit(0))["link"].alias("pdf_url"),
    ).dropDuplicates(["scholar_id"])
    return r if most is None else r.orderBy("page", "position").limit(most)


def atom_entries(payloads: DataFrame) -> DataFrame:
    """A row per entry of arXiv's feed, each arxiv_id once."""
    ns = {"a": "http://www.w3.org/2005/Atom", "x": "http://arxiv.org/schemas/atom"}

    def entries(xml: str | None) -> Iterator[tuple]:
        try:
            root = ElementTree.fromstring(xml or "")
        except ElementTree.ParseError:
            return
        for e in root.iter(f"{{{ns['a']}}}entry"):
            said = lambda p, e=e: re.sub(r"\s+", " ", (e.findtext(p, "", ns) or "")).strip()
            url = said("a:id")
            links = {(link.get("title") or link.get("rel") or ""): link.get("href") for link in e.findall("a:link", ns)}
            yield (url.rpartition("/abs/")[2] or url, said("a:title"), said("a:summary"), [re.sub(r"\s+", " ", n.text or "").strip() for n in e.findall("a:author/a:name", ns)], said("a:published"), url, links.get("pdf"), links.get("doi"), said("x:doi") or None, said("x:journal_ref") or None)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for x in b.payload for r in entries(x)], columns=["raw_id", "title", "abstract", "names", "published", "abs_url", "pdf_url", "doi_link", "own_doi", "journal_ref"])

    r = payloads.select("payload").mapInPandas(each, "raw_id string, title string, abstract string, names array<string>, published string, abs_url string, pdf_url string, doi_link string, own_doi string, journal_ref string")
    date = F.coalesce(F.try_to_date(F.substring("published", 1, 10), "yyyy-MM-dd"), year_of(F.col("published")))
    return r.select(arxiv_id(F.col("raw_id")).alias("arxiv_id"), "title", "abstract", ordered_distinct(F.col("names")).alias("authors"), date.alias("published"), "abs_url", "pdf_url", entry_doi(F.col("own_doi"), F.col("doi_link"), F.col("journal_ref"), F.col("raw_id")).alias("doi"), "journal_ref").dropDuplicates(["arxiv_id"])


def _text(e: ElementTree.Element | None) -> str:
    return "" if e is None else re.sub(r"\s+", " ", "".join(e.itertext())).strip()


def _bare(root: ElementTree.Element) -> ElementTree.Element:
    for e in root.iter():
        if isinstance(e.tag, str):
            e.tag = e.tag.rpartition("}")[2]
    return root


def nxml_parts(xml: str | None) -> tuple[list[tuple[str, str]], dict]:
    """Blocks (kind, text) and metadata of an article; an unreadable one has none."""
    try:
        root = _bare(ElementTree.fromstring(xml or ""))
    except ElementTree.ParseError:
        return [], {}
    title = _text(root.find(".//title-group/article-title"))
    blocks = [("title", title)] if title else []
    for sec in root.iter("sec"):
        if t := _text(sec.find("title")):
            blocks.append(("heading", t))
        for child in sec:
            if child.tag == "p":
                blocks.append(("para", _text(child)))
            elif child.tag == "list":
                blocks += [("bullet", _text(i)) for i in child.iter("list-item")]
    body = root.find(".//body")
    loose = [("para", _text(p)) for p in (body.findall("p") if body is not None else [])]
    dates = {d.get("pub-type") or "": (d.findtext("year") or "").strip() for d in root.iter("pub-date")}
    year = next((y for y in [dates.get("ppub"), dates.get("epub"), *dates.values()] if y), None)
    names = [f"{c.findtext('name/given-names') or ''} {c.findtext('name/surname') or ''}".strip() for c in root.iter("contrib") if c.get("contrib-type") == "author"]
    doi = next((_text(i) for i in root.iter("article-id") if i.get("pub-id-type") == "doi"), None)
    return [b for b in blocks + loose if b[1]], {"title": title or None, "year": year, "authors": [n for n in names if n], "institutes": [t for i in root.findall(".//aff/institution") if (t := _text(i))], "doi": doi}


def nxml_documents(payloads: DataFrame) -> DataFrame:
    """A3: id, blocks, title, year, authors, institutes, doi of each payload."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, x in zip(b.id, b.payload, strict=True):
                blocks, m = nxml_parts(x)
                rows.append((i, [{"kind": k, "text": t} for k, t in blocks], m.get("title"), m.get("year"), m.get("authors", []), m.get("institutes", []), m.get("doi")))
            yield pd.DataFrame(rows, columns=["id", "blocks", "title", "year_text", "names", "insts", "doi"])

    r = payloads.select("id", "payload").mapInPandas(each, "id string, blocks array<struct<kind:string,text:string>>, title string, year_text string, names array<string>, insts array<string>, doi string")
    return r.select("id", "blocks", "title", year_of(F.col("year_text")).alias("year"), ordered_distinct(F.col("names")).alias("authors"), ordered_distinct(F.col("insts")).alias("institutes"), F.lower("doi").alias("doi"))


class _Visible(HTMLParser):
    SILENT = ("script", "style", "noscript", "template")
    BREAKS = ("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "ul", "ol", "table")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.title, self.silent, self.in_title = [], [], 0, False

    def handle_starttag(self, tag, attrs):
        self.silent += tag in self.SILENT
        self.in_title = tag == "title"
        if tag in self.BREAKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in self.SILENT and self.silent:
            self.silent -= 1
        if tag == "title":
            self.in_title = False
        if tag in self.BREAKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.silent:
            (self.title if self.in_title else self.parts).append(data)


def html_text(html: str | None) -> tuple[str, str]:
    """Title and visible text; scripts and styles go, blocks are lines."""
    p = _Visible()
    p.feed(html or "")
    p.close()
    lines = (re.sub(r"[ \t\r\f\v]+", " ", x).strip() for x in "".join(p.parts).split("\n"))
    return re.sub(r"\s+", " ", "".join(p.title)).strip(), "\n".join(x for x in lines if x)


def html_pages(pages: DataFrame, least_chars: int = 1000, least_words: int = 500) -> DataFrame:
    """page_id, title, text, n_words, full_text (long enough to be one)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [html_text(h) for h in b.html]
            yield pd.DataFrame({"page_id": b.page_id, "title": [t for t, _ in got], "text": [x for _, x in got], "n_words": [len(x.split()) for _, x in got], "full_text": [len(x) > least_chars and len(x.split()) > least_words for _, x in got]})

    return pages.select("page_id", "html").mapInPandas(each, "page_id long, title string, text string, n_words long, full_text boolean")


def fetch(ids: DataFrame, get: Callable[[str], str | None], tries: int = 4, pause: Callable[[float], None] | None = None) -> DataFrame:
    """A2, A4, K4: payloads of ids by a function that the caller gives; errors are a column, retried with growing pauses.

    How many run at once is how many partitions `ids` has.
    """
    import random
    import time

    wait = pause or time.sleep

    def one(i: str) -> tuple[str | None, str | None]:
        error = None
        for n in range(tries):
            try:
                return get(i), None
            except Exception as e:  # whatever a fetcher raises is the row's error
                error = f"{type(e).__name__}: {e}"
                if n + 1 < tries:
                    wait(min(1.5 * 2**n, 8) + random.random())
        return None, error

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [one(i) for i in b.id]
            yield pd.DataFrame({"id": b.id, "payload": [p for p, _ in got], "error": [e for _, e in got]})

    return ids.select("id").mapInPandas(each, "id string, payload string, error string")
