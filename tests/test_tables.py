"""Changes in place: values merged column by column, only touched folders written, the same again when repeated."""

import os

import pytest

from ragspark.operators import storage, tables

FIELDS = "k long, a string, b int"


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"a{i}", i) for i in range(1000)], FIELDS)
    return tables.KeyedTable.create(rows, str(tmp_path / "t"), tables.by_range("k", 10))


def files(table):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(table.path) for f in names if f.endswith(".parquet")}


def content(table):
    return {r.k: (r.a, r.b) for r in table.rows().collect()}


def test_one_percent_of_keys_touches_one_percent_of_folders(spark, table):
    before, want = files(table), content(table)
    new = spark.createDataFrame([(i, None, 7) for i in range(500, 510)] + [(503, "x", None)], FIELDS)
    assert table.upsert(new, ["k"]) == [50]
    want |= {i: (want[i][0], 7) for i in range(500, 510)} | {503: ("x", 7)}
    assert content(table) == want
    after = files(table)
    assert {p for p in before if after.get(p) != before[p]} == {p for p in before if "bucket=50/" in p}
    table.upsert(new, ["k"])
    assert content(table) == want
    read = table.rows([50])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull" in read or "bucket" in read.split("PartitionFilters:")[1][:80]


def test_replace_append_remove(spark, table):
    assert table.replace(spark.createDataFrame([(5, None, 1), (2000, "n", 2)], FIELDS), ["k"]) == [0, 200]
    got = content(table)
    assert got[5] == (None, 1) and got[2000] == ("n", 2) and len(got) == 1001
    for _ in range(2):
        table.append(spark.createDataFrame([(5, "late", 9), (2001, "m", None), (2001, "m", None), (None, "z", None)], FIELDS), ["k"])
    got = content(table)
    assert got[5] == (None, 1) and got[2001] == ("m", None) and got[None] == ("z", None) and table.rows().count() == 1003
    for _ in range(2):
        table.append(spark.createDataFrame([(2001, "m", None)], FIELDS), ["k", "a", "b"])
    assert table.rows().count() == 1003
    table.remove(spark.createDataFrame([(i,) for i in range(20, 30)], "k long"), ["k"])
    assert table.rows().count() == 993 and not [p for p in files(table) if "bucket=2/" in p]
    assert table.upsert(spark.createDataFrame([], FIELDS), ["k"]) == []


def test_by_hash_and_null_keys(spark, tmp_path):
    t = tables.KeyedTable.create(spark.createDataFrame([("e1", 1), (None, 2)], "k string, v int"), str(tmp_path / "h"), tables.by_hash("k", 4))
    t.upsert(spark.createDataFrame([("e1", None), ("e2", 5), (None, 3)], "k string, v int"), ["k"])
    assert sorted(map(tuple, t.rows().collect()), key=str) == [("e1", 1), ("e2", 5), (None, 3)]


def test_upsert_documents_merges_repeated_rows(spark):
    old = spark.createDataFrame([(1, "e1", "t", "i"), (2, None, "u", None)], "doc_id long, ext_id string, title string, institute string")
    new = spark.createDataFrame([("e1", "new t", None), ("e1", None, "new i"), ("e9", None, "x"), (None, "w", None), (None, "w", None)], "ext_id string, title string, institute string")
    got = sorted((tuple(r) for r in storage.upsert_documents(old, new).collect()), key=lambda r: r[0])
    assert got[:2] == [(1, "e1", "new t", "new i"), (2, None, "u", None)]
    assert sorted((r[1:] for r in got[2:]), key=str) == sorted([("e9", None, "x"), (None, "w", None), (None, "w", None)], key=str) and [r[0] for r in got] == [1, 2, 3, 4, 5]


def test_mentions_without_spans_are_added_once(spark):
    fields = "doc_id long, start_char int, end_char int, mention_text string, label string"
    m = spark.createDataFrame([(1, None, None, "x", "drug"), (1, 2, 3, "y", None)], fields)
    assert storage.append_mentions(m, m.unionByName(m)).count() == 2
    assert storage.append_mentions(m.limit(0), m.unionByName(m)).count() == 2
