"""Parsers on literal payloads, files, streams, the engine as a whole."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from ragspark.engine import Engine
from ragspark.operators import experiments
from ragspark.operators.filters import Filters
from ragspark.plug import HashEmbedder
from ragspark.sources import files, parsing
from ragspark.streaming import logs

DOC = {"id": "1", "infons": {}, "passages": [{"text": "A Title", "infons": {"type": "title", "year": "2019", "authors": "A B; C D"}}, {"text": "Dept", "infons": {"type": "affiliation"}}, {"text": "Body.", "infons": {"type": "paragraph", "section_type": "INTRO"}}]}


def payloads(spark, *values):
    return spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "id string, payload string")


def test_bioc_shapes(spark):
    p = payloads(spark, json.dumps({"documents": [DOC]}), json.dumps({"collection": {"documents": [DOC, DOC]}}), json.dumps([DOC]), "{}", "not json", None)
    got = {r.id: (r.documents, r.passages) for r in parsing.bioc_counts(p).collect()}
    assert got == {"0": (1, 3), "1": (2, 6), "2": (1, 3), "3": (0, 0), "4": (0, 0), "5": (0, 0)}


def test_bioc_blocks_and_meta(spark):
    p = payloads(spark, json.dumps({"documents": [DOC]}))
    assert [(r.kind, r.text) for r in parsing.bioc_blocks(p).orderBy("ordinal").collect()] == [("title", "A Title"), ("para", "Body.")]
    m = parsing.bioc_meta(p).first()
    assert (m.title, m.year, m.institutes, m.authors) == ("A Title", datetime.date(2019, 1, 1), "Dept", ["A B", "C D"])


ATOM = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><entry><id>http://arxiv.org/abs/2401.1v2</id><title>T
 x</title><summary>S</summary><author><name>A B</name></author><author><name>a b</name></author><published>2024-01-02T00:00:00Z</published><link title="pdf" href="http://p"/><arxiv:doi>10.1/x</arxiv:doi></entry></feed>"""


def test_atom(spark):
    (r,) = parsing.atom_entries(payloads(spark, ATOM, "<broken", None)).collect()
    assert (r.arxiv_id, r.title, r.authors, r.published, r.pdf_url, r.doi) == ("2401.1", "T x", ["A B"], datetime.date(2024, 1, 2), "http://p", "10.1/x")


def test_scholar(spark):
    page = {"organic_results": [{"title": "T", "link": "l", "publication_info": {"authors": [{"name": "A"}, {"name": "a "}], "summary": "J, 2001"}, "resources": [{"file_format": "PDF", "link": "p"}]}, {"result_id": "r1", "title": "U"}, {"result_id": "r1", "title": "U"}]}
    p = spark.createDataFrame([(0, json.dumps(page))], "page int, payload string")
    rows = parsing.scholar_results(p).orderBy("position").collect()
    assert len(rows) == 2 and rows[0].authors == ["A"] and rows[0].pdf_url == "p" and rows[0].year.year == 2001 and len(rows[0].scholar_id) == 16


def test_lookups(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first().x

    assert one(parsing.esearch_ids(F.lit('{"esearchresult": {"idlist": ["1", "2"]}}'))) == ["PMC1", "PMC2"]
    assert one(parsing.idconv_pmcid(F.lit('{"records": [{"pmcid": "PMC9"}]}'))) == "PMC9"
    cross = '{"message": {"relation": {"has-version": [{"DOI": "10.1/V"}]}}}'
    data = '{"data": {"attributes": {"relatedIdentifiers": [{"relationType": "IsVersionOf", "relatedIdentifier": "10.2/W"}]}}}'
    assert one(parsing.journal_doi(F.lit(cross), F.lit(data))) == "10.1/v"
    assert one(parsing.journal_doi(F.lit("{}"), F.lit(data))) == "10.2/w"


NXML = """<article><front><article-meta><article-id pub-id-type="doi">10.3/A</article-id><title-group><article-title>The <i>T</i></article-title></title-group><contrib-group><contrib contrib-type="author"><name><surname>B</surname><given-names>A</given-names></name></contrib></contrib-group><pub-date pub-type="epub"><year>2018</year></pub-date><pub-date pub-type="ppub"><year>2019</year></pub-date><aff><institution>I</institution></aff></article-meta></front><body><sec><title>Methods</title><p>Did.</p><list><list-item><p>one</p></list-item></list></sec><p>Loose.</p></body></article>"""


def test_nxml(spark):
    r = parsing.nxml_documents(payloads(spark, NXML, "<x")).orderBy("id").first()
    assert [(b.kind, b.text) for b in r.blocks] == [("title", "The T"), ("heading", "Methods"), ("para", "Did."), ("bullet", "one"), ("para", "Loose.")]
    assert (r.title, r.year.year, r.authors, r.institutes, r.doi) == ("The T", 2019, ["A B"], ["I"], "10.3/a")


def test_html():
    assert parsing.html_text("<title>T</title><p>a <b>b</b><script>x('</p>')</script><li>c") == ("T", "a b\nc")
    assert parsing.html_text(None) == ("", "")


def test_fetch_retries(spark):
    def get(i):
        if i == "bad":
            raise OSError("no")
        return f"<{i}>"

    ids = spark.createDataFrame([("a",), ("bad",)], "id string")
    rows = {r.id: (r.payload, r.error) for r in parsing.fetch(ids, get, 2, lambda s: None).collect()}
    assert rows == {"a": ("<a>", None), "bad": (None, "OSError: no")}


def test_files(spark, tmp_path):
    (tmp_path / "ids.txt").write_text(" a \n\nb\n")
    assert [r.id for r in files.id_list(spark, str(tmp_path / "ids.txt")).collect()] == ["a", "b"]
    assert files.json_documents(spark, str(tmp_path / "none*.json"), "a int").count() == 0
    (tmp_path / "one.json").write_text('{\n"a": 1}')
    assert files.json_documents(spark, str(tmp_path / "one.json"), "a int").first().a == 1
    files.write_csv(spark.createDataFrame([(1, [2, 3])], "a int, b array<int>"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().b == "[2,3]"
    d = spark.range(100)
    assert {r.id for r in files.sample(d, 10, "id").collect()} == {r.id for r in files.sample(d.repartition(7), 10, "id").collect()}


def test_stream_of_new_files(spark, tmp_path):
    seen = []
    place, state = str(tmp_path / "docs"), str(tmp_path / "state")
    for start in (0, 10):
        spark.range(start, start + 10).write.mode("append").parquet(place)
        logs.incremental(spark, place, "id long", state, lambda df, n: seen.append(df.count())).awaitTermination()
    assert seen == [10, 10]


def test_log_stream(spark, tmp_path):
    rows = experiments.interactions(spark.createDataFrame([("s", 2.0), ("s", 4.0)], "strategy string, latency_ms double"))
    experiments.append_log(rows, str(tmp_path / "log"))
    logs.running_statistics(logs.ab_log(spark, str(tmp_path / "log")), "ab_test_log", str(tmp_path / "cp")).awaitTermination()
    assert spark.table("ab_test_log").first().avg_latency_ms == 3.0
    assert experiments.statistics(experiments.read_log(spark, str(tmp_path / "log"))).first().queries == 2


@pytest.fixture(scope="module")
def engine(spark):
    docs = spark.createDataFrame([], "doc_id long, ext_id string, title string, source string, source_id string, author array<string>, institute string, year date")
    chunks = spark.createDataFrame([], "chunk_id long, doc_id long, chunk_index int, text string, embedding array<float>, embedding_model string, section_name string")
    mentions = spark.createDataFrame([], "mention_id long, doc_id long, mention_text string, label string, start_char int, end_char int, section_name string")
    new = spark.createDataFrame(
        [("pmcid://pmc1", "Cochlea", "PubMed Central", "PMC1", ["Smith J"], "Cochlear implants help hearing loss (p < 0.05). A CT scan was done."), ("arxiv://2401.2", "Stars", "arXiv", "2401.2", ["Chen L"], "Stars burn hydrogen in their cores for long.")],
        "ext_id string, title string, source string, source_id string, author array<string>, text string",
    )
    return Engine(spark, docs, chunks, mentions, HashEmbedder(64)).ingest(new)


def test_ingest_and_search(engine):
    assert engine.docs.count() == 2 and {r.label for r in engine.mentions.collect()} == {"device", "statistical_significance"}
    top = engine.search("hearing loss implants", k=1).first()
    assert top.doc_ref == "PMC1" and top.text.startswith("PMC1\n\n")
    for s in ("ivfflat_ner_boost", "ivfflat_tsvector", "ivfflat_ner_tsvector"):
        assert engine.search("hearing loss", s, 2).count() >= 1


def test_answer(engine):
    got = engine.answer("hearing loss implants", 2)
    assert got["citations"][0]["doc_ref"] == "PMC1" and "PMC1#0" in got["answer"]
    assert engine.answer("hearing", 2, Filters(sources=["Nowhere"]))["answer"] is None
    with pytest.raises(ValueError):
        engine.answer("x", 16)


def test_facets_and_backfill(engine):
    assert engine.facets()["sources"] == ["PubMed Central", "arXiv"]
    _, totals = engine.backfill_mentions({"hydrogen": "drug"})
    assert totals == {"docs": 1, "sections": 1, "mentions": 1}
