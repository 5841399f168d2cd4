r"""WARC archives: revisit resolution by payload digest, and a splittable writer and reader.

A record is one "line" of Spark's text writer whose line end is the record end of the format
(CRLF CRLF), so archives are written and committed by Spark on any file system. They are read
in splits, cut at WARC/1.1 CRLF. That mark has no part that it also begins with, so a reader that
meets half of it at its buffer's end and finds it is none has passed no other; marks that begin
with the line ends before it would not do, since payloads end in line ends too. A payload holding
WARC/1.1 is written in base64 under an extension header, and a header value that ends in it gets a
space, so no cut is wrong.
"""

from __future__ import annotations

import base64
import gzip
import re
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format.
VERSION = "WARC/1.1"
END = "\r\n\r\n"
CUT = f"{VERSION}\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Resolved revisits up to this many rows are broadcast (their count is checked); more are shuffled.
BROADCAST_ROWS = 200_000


def _uuid(text: Column) -> Column:
    h = F.md5(text.cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))


def _record_id(page_id: Column, digest: Column) -> Column:
    return _uuid(F.concat_ws(":", F.lit("response"), F.coalesce(page_id.cast("string"), F.lit("")), digest))


def warc_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (text whose UTF-8 bytes are the payload), payload_bytes, payload_digest."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload.cast("binary"), 256).alias("payload_digest"))


def resolve(headers: DataFrame, keep: Callable[[DataFrame, str], DataFrame], min_bytes: int = 100) -> DataFrame:
    """The revisits among `headers` (page_id, url, payload_bytes, payload_digest): page_id, payload_digest, refers_to, refers_url.

    Headers alone are shuffled by digest: a partial minimum finds each digest's original, `keep(df,
    name)` stores the originals of digests that occur again, and a join takes them back to the
    others, and stores them. From table to table both sides of that join are plain shuffles with
    nothing behind them that needs its partitions, so a hot digest's is split. A null page_id is an
    original only if it has no other. Repeated rows: one row.
    """
    h = headers.filter(F.col("payload_bytes") >= min_bytes).select("page_id", "url", "payload_digest")
    first = h.groupBy("payload_digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "url")).alias("_o"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    first = keep(first.select("payload_digest", F.col("_o.page_id").alias("refers_to"), F.col("_o.url").alias("refers_url")), "originals")
    joined = h.join(first, "payload_digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return keep(joined.select("page_id", "payload_digest", "refers_to", "refers_url"), "again").distinct()


def today() -> str:
    """The date of fresh headers: now, in the format's form."""
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing for null; a line break in a value would end it."""
    line = F.regexp_replace(value.cast("string"), r"[\r\n]+", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), line, F.when(F.endswith(line, F.lit(VERSION)), F.lit(" ")).otherwise(F.lit("")), F.lit("\r\n")), F.lit(""))


def write(spark: SparkSession, recs: DataFrame, revisits: DataFrame, path: str, date: str | None = None) -> None:
    """Deduplicated archives with fresh headers: a full record for each response, a head for each revisit.

    `revisits` has at most one row for a page_id and digest; up to BROADCAST_ROWS of them (counted)
    are broadcast so that payloads stay where they are, more are joined by a shuffle. `date` (of the
    run, unless given) is that of all records, so also that of the records referred to.
    """
    date = date or today()
    few = revisits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    v = revisits.select(F.col("page_id").alias("_p"), F.col("payload_digest").alias("_d"), "refers_to", "refers_url", F.lit(True).alias("_again"))
    on = F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("payload_digest") == F.col("_d"))
    r = recs.join(F.broadcast(v) if few else v, on, "left").withColumn("_again", F.coalesce("_again", F.lit(False)))
    coded = F.contains(F.col("payload"), F.lit(VERSION)) & ~F.col("_again")
    body = F.when(F.col("_again"), F.lit("")).when(coded, F.base64(F.col("payload").cast("binary"))).otherwise(F.col("payload"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    original = _record_id(F.col("refers_to"), F.col("payload_digest"))
    own = F.when(F.col("_again"), _uuid(F.concat_ws(":", F.lit("revisit"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), "payload_digest"))).otherwise(_record_id(F.col("page_id"), F.col("payload_digest")))
    head = F.concat(
        F.lit(f"{VERSION}\r\n"),
        _header("WARC-Type", F.when(F.col("_again"), F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", own),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        _header("WARC-Profile", F.when(F.col("_again"), F.lit(PROFILE))),
        _header("WARC-Refers-To", F.when(F.col("_again"), original)),
        _header("WARC-Refers-To-Target-URI", F.when(F.col("_again"), F.col("refers_url"))),
        _header("WARC-Refers-To-Date", F.when(F.col("_again"), F.lit(date))),
        _header("X-Page-ID", F.col("page_id")),
        _header("X-Refers-To-Page-ID", F.when(F.col("_again"), F.col("refers_to"))),
        _header("X-Payload-Encoding", F.when(coded, F.lit("base64"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _header("Content-Length", F.octet_length(http) + F.octet_length(body)),
    )
    r.select(F.concat(head, F.lit("\r\n"), http, body).alias("value")).write.mode("overwrite").option("lineSep", END).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of archives that write() made: headers as columns, payload (binary) as read."""
    lines = spark.read.option("lineSep", CUT).text(path).filter("value <> ''")  # what precedes a file's first mark
    head = F.concat(F.lit("\r\n"), F.substring_index("value", END, 1), F.lit("\r\n"))
    raw = F.expr("substring(cast(value as binary), octet_length(substring_index(value, '\\r\\n\\r\\n', 1)) + 5)")

    def field(name: str) -> Column:
        x = F.regexp_extract("_head", rf"\r\n{name}: ([^\r]*)\r\n", 1)
        return F.when(F.contains("_head", F.lit(f"\r\n{name}: ")), F.regexp_replace(x, "(WARC/1\\.1) $", "$1"))

    r = lines.select(head.alias("_head"), raw.alias("_raw"))
    r = r.withColumn("_block", F.expr("substring(_raw, 1, cast(%s as int))" % r"regexp_extract(_head, '\\r\\nContent-Length: ([0-9]+)\\r\\n', 1)"))
    r = r.withColumn("_http", F.substring_index(F.col("_block").cast("string"), END, 1))
    body = F.expr("substring(_block, octet_length(_http) + 5)")
    return r.select(
        field("WARC-Type").alias("record_type"),
        field("WARC-Record-ID").alias("record_id"),
        field("WARC-Target-URI").alias("url"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha256:", "").alias("stated_digest"),
        F.regexp_extract("_http", r"Content-Length: ([0-9]+)", 1).cast("long").alias("stated_bytes"),
        field("WARC-Refers-To").alias("refers_to_record"),
        field("X-Page-ID").cast("long").alias("page_id"),
        field("X-Refers-To-Page-ID").cast("long").alias("refers_to"),
        F.when(field("X-Payload-Encoding") == "base64", F.unbase64(body.cast("string"))).otherwise(body).alias("payload"),
    )


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive, plain or gzipped record by record, by stated lengths."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    pos = 0
    while (begin := data.find(b"WARC/", pos)) >= 0:
        end = data.find(b"\r\n\r\n", begin)
        if end < 0:
            return
        lines = data[begin:end].decode("utf-8", "replace").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = int(head.get("content-length", 0))
        yield head, data[end + 4 : end + 4 + size]
        pos = end + 4 + size


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Response and revisit records of archives from elsewhere (files under 2 GB, each read as one): as read() gives them.

    Without an X-Page-ID a record is numbered by a hash of its id. The stated digest is of any kind.
    Records of other types are left out; absent headers are null, an absent record id is empty, and
    a record whose end is missing has the bytes that are there. Repeated records: a row each. An
    empty file or folder: no rows.
    """
    schema = "record_type string, record_id string, url string, stated_digest string, stated_bytes long, refers_to_record string, page_id long, refers_to long, payload binary"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            for data in batch.column("content"):
                rows = []
                for head, block in parse(data.as_py()):
                    if head.get("warc-type") not in ("response", "revisit"):
                        continue
                    http, _, body = block.partition(b"\r\n\r\n") if "application/http" in head.get("content-type", "") else (b"", b"", block)
                    length = re.search(rb"(?i)\r\ncontent-length: *([0-9]+)", b"\r\n" + http)
                    rid = head.get("warc-record-id", "")
                    number = head.get("x-page-id") or xxhash.xxh3_64_intdigest(rid) >> 1
                    refers = head.get("x-refers-to-page-id")
                    if head.get("x-payload-encoding") == "base64":
                        body = base64.b64decode(body)
                    rows.append((head["warc-type"], rid, head.get("warc-target-uri"), head.get("warc-payload-digest", "").removeprefix("sha256:") or None, int(length[1]) if length else len(body), head.get("warc-refers-to"), int(number), int(refers) if refers else None, body))
                if rows:
                    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(each, schema)


def restore(records: DataFrame) -> DataFrame:
    """page_id, url, html of every record: revisits are joined to the original response of their digest.

    Digests and originals' ids alone are shuffled to find one original each; its payload then goes
    to its revisits. A revisit whose original is nowhere has null html, and so has one of null digest.
    Repeated records: a row each; of several originals of a digest that of the smallest record id
    (ties: either, their payloads are equal). Empty table: no rows. Bytes that are no UTF-8 are
    replaced. Other columns are not read.
    """
    full = records.filter("record_type = 'response'")
    again = records.filter("record_type = 'revisit'").select("page_id", "url", "stated_digest")
    wanted = again.select("stated_digest").distinct()
    one = full.select("stated_digest", "record_id").join(wanted, "stated_digest", "left_semi").groupBy("stated_digest").agg(F.min("record_id").alias("record_id"))
    source = full.join(one, ["stated_digest", "record_id"], "left_semi").dropDuplicates(["stated_digest"]).select("stated_digest", F.col("payload").cast("string").alias("html"))
    return full.select("page_id", "url", F.col("payload").cast("string").alias("html")).unionByName(again.join(source, "stated_digest", "left").select("page_id", "url", "html"))


def rewrite(spark: SparkSession, records: DataFrame, path: str, keep, date: str | None = None) -> None:
    """Records of any archives as new ones: each payload once, revisits of it elsewhere, fresh headers.

    A revisit without its original becomes a response of an empty payload; repeated rows are written
    each; nulls and empty tables as in deduplicate().
    """
    recs = warc_records(keep(restore(records), "restored"))
    write(spark, recs, keep(resolve(recs.drop("payload"), keep), "revisits"), path, date)


def deduplicate(spark: SparkSession, pages: DataFrame, path: str, keep, date: str | None = None) -> DataFrame:
    """Writes `pages` as deduplicated archives under `path` and returns what they hold, a row per page.

    `keep(df, name)` stores a table. Null html: empty payload. Payloads under 100 bytes are never
    revisits. Repeated rows of the smallest page_id are all responses. Null url or page_id: the
    header is left out. Empty table: no rows. Other columns are not read.
    """
    recs = warc_records(pages)
    write(spark, recs, keep(resolve(recs.drop("payload"), keep), "revisits"), path, date)
    r = read(spark, path)
    full = F.col("record_type") == "response"
    return r.select(
        "page_id",
        F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("stated_bytes")).alias("payload_bytes"),
        F.when(full, F.sha2("payload", 256)).otherwise(F.col("stated_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


WARC_SQL = """
WITH h AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes < 100 OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN payload_bytes < 100 OR page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM o
"""
