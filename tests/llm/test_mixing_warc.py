"""Mixing and WARC against plain code."""

import hashlib
import random
import re

import duckdb
import pytest

from ragspark.llm import mixing, warc
from ragspark.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def mixed(docs_df):
    d = docs_df.drop("size").withColumn("size", mixing.word_count("text"))
    return mixing.mix_sources(d, Scratch(docs_df.sparkSession, "mixed").save).collect()


def plain_targets(sizes: dict) -> dict:
    """Round by round, as the contract words it."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > 2 * sizes[s] + 1e-9}
        if not over:
            out |= {s: left * w[s] / total for s in free}
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in over)
        free -= over
    return out


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_bounds(docs, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.choice([0, 3, 10, 50, 200])), "en", rng.choice(["a", "b", "c", "Ä", "d", None, "a", "a"])) for i in range(600)]
    got = mixed(docs(rows))
    sizes: dict = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1]))
    want = plain_targets(sizes)
    taken: dict = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert len(got) == 600
    for s, t in taken.items():
        assert abs(t - want[s]) <= max(400, 0.1 * want[s])


def test_expected_copies_are_crossed(docs):
    """Each source's copies add up to the prefix sum's whole numbers."""
    got = mixed(docs([(i, "a b c", "en", "xy"[i % 2]) for i in range(500)]))
    for s in "xy":
        mine = [r for r in got if r.source == s]
        each = mine[0].target / mine[0].source_size
        assert abs(sum(r.copies for r in mine) - each * len(mine)) <= 1


def test_mixing_odd_rows(docs, spark):
    rows = [(None, None, None, None), (1, "", None, None), (2, "a b", None, "s"), (2, "a b", None, "s"), (3, " \t\n ", None, "t"), (4, "x " * 50000, None, "u")]
    got = mixed(docs(rows))
    assert len(got) == 6 and {r.doc_id for r in got if r.source is None} == {None, 1}
    assert all(r.taken == 0 for r in got if r.source in (None, "t"))
    assert sorted(map(repr, mixed(docs(rows)))) == sorted(map(repr, mixed(docs(rows))))
    assert mixed(docs([])) == []


def test_mixing_sql(spark, docs, sf_dir, scratch):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ours = {(r.doc_id, r.size, r.source_size, r.target, r.copies, r.taken) for r in mixing.mix_sources(d.select("doc_id", "source", mixing.word_count("text").alias("size")), scratch.save).collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert ours == set(c.execute(mixing.MIX_SQL).fetchall())


@pytest.mark.parametrize("most", [3, 40])
def test_large_groups_are_split(spark, docs, scratch, most):
    """Thousands of empty texts of one source: parts by count, the same rows as SQL with that bound, and each crossing once."""
    d = docs([(i, "" if i % 3 else "a b c", "en", None if i % 2 else "s") for i in range(3000)]).select("doc_id", "text", "source")
    got = mixing.mix_sources(d.withColumn("size", mixing.word_count("text")), scratch.save, most=most)
    documents = d.toPandas()  # noqa: F841 - the SQL's table
    want = duckdb.sql(mixing.MIX_SQL.replace("/ 100000.0", f"/ {most}.0")).fetchall()
    assert {(r.doc_id, r.size, r.source_size, r.target, r.copies, r.taken) for r in got.collect()} == set(want)
    parts = spark.read.parquet(scratch.path("placed"))
    assert parts.count() > 32 * 4 and parts.agg({"_p": "max"}).first()[0] > 0


def test_mixing_clashing_names(docs, scratch):
    d = docs([(1, "a b", "en", "s"), (2, "c", "en", "t")]).drop("size").withColumn("size", mixing.word_count("text")).selectExpr("*", "'x' as target", "9 as source_size", "'y' as _s", "1 as taken")
    got = {r.doc_id: (r.source_size, r.target) for r in mixing.mix_sources(d, scratch.save).collect()}
    assert {i: s for i, (s, _) in got.items()} == {1: 2, 2: 1} and sum(t for _, t in got.values()) == pytest.approx(4.5)


def test_mixing_is_native(docs, scratch):
    d = mixing.mix_sources(docs([(1, "a", "en", "s")]).drop("size").withColumn("size", mixing.word_count("text")), scratch.save)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    assert plan.count("Exchange hash") == 1  # documents are shuffled once


def test_mixing_many_groups(docs, monkeypatch):
    rows = [(i, "w " * (i % 40), "en", "abc"[i % 3]) for i in range(300)]
    few = sorted(map(repr, mixed(docs(rows))))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert sorted(map(repr, mixed(docs(rows)))) == few


PAGES = "page_id long, url string, html string"


def archived(spark, scratch, rows):
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "'z' as record_type", "'q' as payload")
    return warc.deduplicate(spark, pages, scratch.path("archives"), scratch.save)


def plain_pages(rows):
    first: dict = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        b = (html or "").encode()
        again = len(b) >= 100 and (html or "") in first and first[html or ""] != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[html or ""] if again else None))
    return sorted(out, key=repr)


def test_round_trip(spark, scratch):
    odd = ["", None, "short", "é" * 60, "x" * 99, "y" * 100, "tail\r\n\r\n" * 20, "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n" * 5, "a\x00b" * 50, "z" * 300_000]
    rows = [(i, None if i % 5 == 0 else f"http://h/{i}\r\nX: y", odd[i % len(odd)]) for i in range(60)]
    rows += [(3, "u", odd[3]), (None, "u", "n" * 120), (None, None, "y" * 100)]
    got = archived(spark, scratch, rows)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_pages(rows)


def test_archives_hold_each_payload_once(spark, scratch):
    rows = [(i, "u", "same " * 40) for i in range(50)]
    archived(spark, scratch, rows).collect()
    full = warc.read(spark, scratch.path("archives"))
    kinds = {r.record_type: r["count"] for r in full.groupBy("record_type").count().collect()}
    assert kinds == {"response": 1, "revisit": 49}
    one = full.filter("record_type = 'response'").first()
    back = full.filter("record_type = 'revisit'").first()
    assert back.refers_to_record == one.record_id and bytes(one.payload) == b"same " * 40 and len(back.payload) == 0


def test_warc_empty(spark, scratch):
    assert archived(spark, scratch, []).count() == 0


def test_warc_shuffled_join(spark, scratch, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    rows = [(i, "u", "same " * 40) for i in range(20)]
    assert sorted((tuple(r) for r in archived(spark, scratch, rows).collect()), key=repr) == plain_pages(rows)


def test_hot_digest_is_split(spark, scratch):
    """Two thirds of the headers under one digest: the join that takes the original back is cut into tasks."""
    rows = [(i, f"http://h/{i}", "same " * 40 if i % 3 else f"{i} " * 60) for i in range(6000)]
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k) for k in held}
    plans = []

    def keep(df, name):
        out = scratch.save(df, name)
        if name == "again":
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        recs = scratch.save(warc.warc_records(spark.createDataFrame(rows, PAGES).repartition(8)).drop("payload"), "headers")
        found = warc.resolve(recs, keep).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(found) == 3999 and {r.refers_to for r in found} == {1}
    assert "skew=true" in plans[0]


def test_dates(spark, scratch):
    pages = spark.createDataFrame([(i, "u", "same " * 40) for i in range(2)], PAGES)
    warc.deduplicate(spark, pages, scratch.path("archives"), scratch.save, date="2024-02-03T04:05:06Z")
    text = "".join(r.value for r in spark.read.option("lineSep", "\x00").text(scratch.path("archives")).collect())
    assert text.count("WARC-Date: 2024-02-03T04:05:06Z") == 2 and text.count("WARC-Refers-To-Date: 2024-02-03T04:05:06Z") == 1


def test_rewrite_archives(spark, scratch):
    """Two archives with revisits of their own become one set: a payload once, every page restored."""
    rows = [(i, f"http://h/{i}", ["p" * 150, "q" * 150, "short", "\r\n\r\nWARC/1.1\r\n" * 9][i % 4]) for i in range(24)]
    for k in range(2):
        pages = spark.createDataFrame(rows[k * 12 : k * 12 + 12], PAGES)
        warc.deduplicate(spark, pages, scratch.path(f"in{k}"), lambda df, n, k=k: scratch.save(df, f"{n}{k}")).collect()
    both = warc.read(spark, scratch.path("in0")).unionByName(warc.read(spark, scratch.path("in1")))
    warc.rewrite(spark, both, scratch.path("out"), scratch.save)
    out = warc.read(spark, scratch.path("out"))
    assert out.filter("record_type = 'response'").count() == 3 + 6
    back = {(r.page_id, r.url, r.html) for r in warc.restore(out).collect()}
    assert back == set(rows)
    by_parser = warc.read_any(spark, scratch.path("out"))
    assert {(r.page_id, r.url, r.html) for r in warc.restore(by_parser).collect()} == set(rows)


def test_foreign_archive(spark, tmp_path):
    import gzip

    def record(kind, rid, body, extra=b""):
        return b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: " + rid + b"\r\n" + extra + b"Content-Type: application/http;msgtype=response\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"

    page = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>WARC/1.0\r\n\r\n</p>"
    data = [record(b"warcinfo", b"<0>", b"x"), record(b"response", b"<1>", page, b"WARC-Payload-Digest: sha1:A\r\n"), record(b"revisit", b"<2>", b"HTTP/1.1 200 OK\r\n\r\n", b"WARC-Payload-Digest: sha1:A\r\n"), record(b"revisit", b"<3>", b"", b"WARC-Payload-Digest: sha1:B\r\n")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in data))
    (tmp_path / "b.warc").write_bytes(b"".join(data))
    got = warc.read_any(spark, str(tmp_path))
    assert got.count() == 6
    html = sorted((r.html or "") for r in warc.restore(got).collect())
    assert html == ["", ""] + ["<p>WARC/1.0\r\n\r\n</p>"] * 4


def test_warc_no_page_is_lost_at_buffer_edges(spark, tmp_path):
    """Payloads of all ends, these on every offset around the reader's buffer of 65,536 bytes."""

    def record(page_id, payload):
        http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload)
        return b"WARC/1.1\r\nWARC-Type: response\r\nX-Page-ID: %d\r\nContent-Length: %d\r\n\r\n" % (page_id, len(http) + len(payload)) + http + payload + b"\r\n\r\n"

    want, n = [], 0
    for tail in (b"", b"\r", b"\n", b"\r\n", b"\r\n\r\n", b"\n\r", b"WARC/1."):
        for back in range(-14, 15):
            first = 65536 - len(record(n, b"x" * 60000)) + 60000 - back
            payloads = [b"x" * first + tail, b"second" + tail, tail, b"y" * 65000 + tail]
            (tmp_path / f"{n}.warc").write_bytes(b"".join(record(n + i, p) for i, p in enumerate(payloads)))
            want += [(n + i, p) for i, p in enumerate(payloads)]
            n += 4
    got = sorted((r.page_id, bytes(r.payload)) for r in warc.read(spark, str(tmp_path)).select("page_id", "payload").collect())
    assert [g[0] for g in got] == [w[0] for w in want] and got == want


def test_warc_marks_in_headers_and_payloads(spark, scratch):
    """The mark of a record in an address or a page, and pages that end in line ends."""
    rows = [(1, "http://a/WARC/1.1", "<html>WARC/1.1"), (2, "WARC/1.1", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 5), (3, "u", "x" * 200 + "\r\n\r\n"), (4, "v", "x" * 200 + "\r\n\r\n"), (5, None, "\r\n")]
    warc.deduplicate(spark, spark.createDataFrame(rows, PAGES), scratch.path("archives"), scratch.save)
    got = {(r.page_id, r.url, r.html) for r in warc.restore(warc.read(spark, scratch.path("archives"))).collect()}
    assert got == set(rows)
