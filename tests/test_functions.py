"""Goldens of the scalar functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from ragspark.functions import identifiers as ident
from ragspark.functions import text as tx
from ragspark.functions import vectors as vec


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text,expected",
    [("A b. Cd e? 9 x", ["A b.", "Cd e?", "9 x"]), ("e.g. lower", ["e.g. lower"]), ("", []), (None, []), ("  One.\nTwo. ", ["One.", "Two."])],
)
def test_sentences(spark, text, expected):
    assert one(spark, tx.sentences(F.lit(text).cast("string"))) == expected


@pytest.mark.parametrize("text,expected", [("a b c d e f g", ["a b c d", "d e f g", "g"]), ("", []), (None, []), (" a ", ["a"])])
def test_chunk_by_tokens(spark, text, expected):
    assert one(spark, tx.chunk_by_tokens(F.lit(text).cast("string"), 4, 1)) == expected


def test_chunk_by_tokens_bad(spark):
    with pytest.raises(ValueError):
        tx.chunk_by_tokens(F.lit("a"), 4, 4)


@pytest.mark.parametrize("ext,expected", [("pmcid://pmc7", "PMC7"), ("arxiv://2401.1", "2401.1"), ("foo", "foo"), (None, "UNKNOWN")])
def test_doc_ref(spark, ext, expected):
    assert one(spark, ident.doc_ref(F.lit(ext).cast("string"))) == expected


@pytest.mark.parametrize(
    "fn,x,expected",
    [
        (ident.arxiv_id, "arXiv:2401.01234v2", "2401.01234"),
        (ident.doi, "https://doi.org/10.1109/ABC", "10.1109/abc"),
        (ident.arxiv_doi, "arXiv:2401.01234v2", "10.48550/arXiv.2401.01234"),
        (ident.find_doi, "see 10.1000/Xy.1 there", "10.1000/xy.1"),
        (ident.find_doi, "none", None),
        (ident.uri, " HTTP://A.b/ ", "http://a.b"),
        (ident.year_of, "J, 1999 - 2004", datetime.date(1999, 1, 1)),
        (ident.year_of, "12345", None),
        (ident.authors, "A; B;;  C ", ["A", "B", "C"]),
        (ident.authors, "", None),
        (ident.authors, " ; ", None),
        (ident.norm_authors, "A B, a b;C\nD", ["A B", "C", "D"]),
        (ident.sanitize_arxiv_query, 'hair AND ("cell loss" OR ORBIT) ("open access"[filter]) (2019:2024[dp])', 'all:"hair" AND (all:"cell loss" OR all:"ORBIT")'),
        (ident.pmcid, " pmc12 ", "PMC12"),
    ],
)
def test_identifiers(spark, fn, x, expected):
    assert one(spark, fn(F.lit(x))) == expected


def test_citations(spark):
    got = one(spark, ident.citations(F.lit("x [PMC12#3] y [pmc12:3] [PMCID:4] [arXiv:1.2#1] [PMC7; PMC8 #2]")))
    assert [tuple(r) for r in got] == [("PMC12", 3), ("PMC7", 2)]


@pytest.mark.parametrize("user,four,three", [("u1", 0, 1), ("user123", 3, 0), ("user_12345", 1, 2)])
def test_assigned(spark, user, four, three):
    import hashlib

    n = int(hashlib.md5(user.encode()).hexdigest(), 16)
    assert (n % 4, n % 3) == (four, three)
    assert one(spark, ident.assigned(F.lit(user), 4)) == four and one(spark, ident.assigned(F.lit(user), 3)) == three


def test_highlight(spark):
    got = one(spark, tx.highlight(F.lit("Hearing aids help hearing"), "What hearing loss?"))
    assert got == "<mark>Hearing</mark> aids help <mark>hearing</mark>"


def test_vectors(spark):
    a, b = vec.literal([3, 4]), vec.literal([4, 3])
    assert one(spark, vec.cosine(a, b)) == pytest.approx(0.96)
    assert one(spark, vec.cosine(a, vec.literal([0, 0]))) is None
    assert one(spark, vec.l2_distance(a, b)) == pytest.approx(2**0.5)
    assert one(spark, vec.normalize(a)) == pytest.approx([0.6, 0.8])
    assert one(spark, vec.parse(F.lit("[0.5,-1]"))) == [0.5, -1.0]


def test_query_terms_are_safe(spark):
    assert tx.query_terms("What's (new): a!") == ["what", "s", "new", "a"]
    assert one(spark, tx.matches(F.lit(["a", "b"]), ["a", "c"])) is False
    assert one(spark, tx.matches(F.lit(["a", "b"]), ["a", "c"], "or")) is True
    assert one(spark, tx.matches(F.lit(["a"]), [])) is False


def test_char_budget(spark):
    from pyspark.sql import Window

    d = spark.createDataFrame([(0, "abcd"), (1, "efgh"), (2, "x")], "i int, t string")
    d = d.withColumn("r", F.sum(F.length("t")).over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    got = [r.x for r in d.orderBy("i").select(tx.char_budget(F.length("t"), F.col("r"), 6).alias("x")).collect()]
    assert got == [4, 2, 0]
