"""The registered queries of the retrieval engine, each with DuckDB SQL where that can express it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identifiers as ident
from ..functions import text as tx
from ..functions import vectors as vec
from ..operators import evaluation as ev
from ..functions import fulltext
from ..operators import answers, benchmark, experiments, facets, ivf, mention_vectors, ner, retrieval, storage, tables
from ..operators import filters as flt
from ..operators.chunking import chunk_documents
from ..operators.ivf import suggested_lists
from ..plug import ExtractiveGenerator, HashEmbedder, prompt_context
from ..session import own_folder
from ..sources import files, paged, parsing, requests
from ..streaming import feedback
from .derived import MODEL, SQL, Tables

_FOUND: dict[str, tuple[Callable, str | None]] = {}
QUERY = "the of and"


def query(sql: str | None = None):
    """Registers a function of Tables under its name; `sql` may use derived.SQL's tables."""

    def add(f: Callable[[Tables], DataFrame]):
        text = None
        if sql is not None:
            more = sql.lstrip()
            text = f"WITH {SQL}{', ' + more[5:] if more.startswith('WITH ') else more}"
        _FOUND[f.__name__] = (f, text)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for n, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in _FOUND.items() if s}


# --- SQL pieces -------------------------------------------------------------------------------

Q0 = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"
TERMS = "list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w <> '')"
SIM = f"scored AS (SELECT *, round(list_cosine_similarity(embedding, {Q0}), 6) AS similarity FROM chunks WHERE embedding_model = '{MODEL}')"
NEAR30 = f"{SIM}, v AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, chunk_id) AS vector_rank FROM scored QUALIFY vector_rank <= 30)"


def _text_sql(terms: tuple[str, ...]) -> str:
    test = " AND ".join(f"list_contains(w, '{t}')" for t in terms)
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""worded AS (SELECT *, {TERMS} AS w FROM chunks WHERE embedding_model = '{MODEL}'),
      t AS (SELECT *, round(CAST(len(list_filter(w, lambda x: x IN ({listed}))) AS DOUBLE) / len(w), 6) AS text_score, row_number() OVER (ORDER BY round(CAST(len(list_filter(w, lambda x: x IN ({listed}))) AS DOUBLE) / len(w), 6) DESC, chunk_id) AS text_rank
        FROM worded WHERE {test} QUALIFY text_rank <= 30),
      vt AS (SELECT chunk_id, coalesce(v.doc_id, t.doc_id) AS doc_id, coalesce(v.section_name, t.section_name) AS section_name, coalesce(similarity, 0) AS similarity, text_score, vector_rank, text_rank FROM v FULL JOIN t USING (chunk_id))"""


T = _text_sql(("the", "of", "and"))
NONE = _text_sql(("zzzzqqq",))
COUNTS = "mc AS (SELECT doc_id, section_name, count(*) AS mention_count, list_sort(list(DISTINCT label)) AS entity_types FROM mentions WHERE section_name IS NOT NULL GROUP BY ALL)"
NER = "least(1.0::DOUBLE, ln(1 + coalesce(mention_count, 0)) / ln(11.0::DOUBLE))"
RRF = "SELECT chunk_id, doc_id, similarity, text_score, vector_rank, text_rank, round(1.0::DOUBLE / (60.0::DOUBLE + coalesce(vector_rank, 31)) + 1.0::DOUBLE / (60.0::DOUBLE + coalesce(text_rank, 31)), 8) AS final_score FROM vt ORDER BY final_score DESC, chunk_id LIMIT 10"
NORM = "coalesce(text_score / nullif(max(text_score) OVER (), 0), 0)"
WEIGHTED = f"SELECT chunk_id, doc_id, similarity, text_score, coalesce(vector_rank, 999999) AS vector_rank, coalesce(text_rank, 999999) AS text_rank, round(0.7::DOUBLE * similarity + 0.3::DOUBLE * {NORM}, 6) AS final_score FROM vt ORDER BY final_score DESC, chunk_id LIMIT 10"
FULL = f"SELECT chunk_id, doc_id, similarity, text_score, coalesce(vector_rank, 999999) AS vector_rank, coalesce(text_rank, 999999) AS text_rank, coalesce(mention_count, 0) AS mention_count, array_to_string(coalesce(entity_types, []), ',') AS entity_types, round(0.5::DOUBLE * similarity + 0.3::DOUBLE * {NORM} + 0.2::DOUBLE * {NER}, 6) AS final_score FROM vt LEFT JOIN mc USING (doc_id, section_name) ORDER BY final_score DESC, chunk_id LIMIT 10"
BOOST = f"SELECT chunk_id, doc_id, similarity, coalesce(mention_count, 0) AS mention_count, array_to_string(coalesce(entity_types, []), ',') AS entity_types, round(0.15::DOUBLE * {NER}, 6) AS boost, round(similarity + round(0.15::DOUBLE * {NER}, 6), 6) AS final_score FROM v LEFT JOIN mc USING (doc_id, section_name) ORDER BY final_score DESC, similarity DESC, chunk_id LIMIT 10"


def joined(df: DataFrame) -> DataFrame:
    return df.withColumn("entity_types", F.array_join("entity_types", ","))


# --- retrieval --------------------------------------------------------------------------------


@query(f"WITH {SIM}, h AS (SELECT * FROM scored ORDER BY similarity DESC, chunk_id LIMIT 10) SELECT chunk_id, doc_id, similarity, similarity AS final_score, chunk_index, title, source, CASE WHEN ext_id LIKE 'pmcid%' THEN upper(regexp_replace(ext_id, '^[a-z]+://', '')) ELSE regexp_replace(ext_id, '^[a-z]+://', '') END AS doc_ref, CAST(year(year) AS INTEGER) AS year, institute AS institution, array_to_string(author, '; ') AS authors, round(1 - similarity, 6) AS distance FROM h JOIN docs USING (doc_id)")
def vector_topk(t: Tables) -> DataFrame:
    hits = retrieval.vector_only(t.chunks, t.vector(), 10, MODEL)
    return retrieval.contexts(hits, t.chunks, t.docs).withColumn("authors", F.array_join("authors", "; ")).drop("text")


@query(f"SELECT chunk_id, round(list_distance(embedding, {Q0}), 6) AS distance FROM chunks ORDER BY distance, chunk_id LIMIT 10")
def l2_topk(t: Tables) -> DataFrame:
    return retrieval.l2_nearest(t.chunks, t.vector())


@query(f"WITH {SIM} SELECT chunk_id, scored.doc_id, similarity, similarity AS final_score FROM scored JOIN docs USING (doc_id) WHERE (lower(author[1]) LIKE '%smith 1%' OR lower(author[2]) LIKE '%smith 1%' OR lower(author[2]) LIKE '%chen 3%') AND year(year) BETWEEN 2005 AND 2020 AND lower(institute) LIKE '%institute en%' AND source IN ('arXiv', 'PubMed Central') ORDER BY similarity DESC, chunk_id LIMIT 10")
def vector_topk_filtered(t: Tables) -> DataFrame:
    f = flt.Filters(authors=["Smith 1", "chen 3"], year_min=2005, year_max=2020, institutions=["institute en"], sources=["arXiv", "PubMed Central"])
    return retrieval.filtered(t.chunks, t.docs, t.vector(), f, 10, MODEL)


@query(f"WITH {NEAR30}, {COUNTS} {BOOST}")
def ner_boost(t: Tables) -> DataFrame:
    return joined(retrieval.ner_boost(t.chunks, t.mentions, t.vector(), 10, MODEL))


@query(f"WITH {NEAR30}, {T} SELECT chunk_id, doc_id, text_score, text_rank FROM t")
def text_topk(t: Tables) -> DataFrame:
    hits = retrieval.text_matches(t.chunks, QUERY, 30, index=t.word_index, model=MODEL)
    return retrieval.ranked(hits, "text_score", "text_rank")


@query()
def stemmed_text_topk(t: Tables) -> DataFrame:
    return retrieval.text_matches(t.whole_chunks, "onions eren the", 30, "or", index=t.english_index)


UPDATED = f"""updated AS (SELECT chunk_id, doc_id, CASE WHEN chunk_id % 10 = 0 THEN 'the of and ' || text ELSE text END AS text FROM chunks WHERE chunk_id % 7 <> 0),
  uw AS (SELECT chunk_id, doc_id, {TERMS} AS w FROM updated)
  SELECT chunk_id, doc_id, round(CAST(len(list_filter(w, lambda x: x IN ('the', 'of', 'and'))) AS DOUBLE) / len(w), 6) AS text_score FROM uw
  WHERE list_has_all(w, ['the', 'of', 'and']) ORDER BY text_score DESC, chunk_id LIMIT 30"""


@query(f"WITH {UPDATED}")
def text_topk_after_update(t: Tables) -> DataFrame:
    """The index after a tenth of the chunks changed and a seventh went: a segment in a folder of its own, beside the first."""
    changed = t.chunks.filter("chunk_id % 10 = 0 and chunk_id % 7 <> 0").withColumn("text", F.concat(F.lit("the of and "), "text"))
    index = t.word_index.update(changed, t.chunks.filter("chunk_id % 7 = 0"), f"{own_folder(t.spark, 'updated')}/index")
    return index.search(QUERY, 30).select("chunk_id", "doc_id", "text_score")


@query()
def english_terms(t: Tables) -> DataFrame:
    """Each stem of the whole texts' chunks with the chunks that have it and its highest frequency in one."""
    return t.english_index.terms().drop("segment")


@query()
def batch_stems(t: Tables) -> DataFrame:
    """Stemmed search for the benchmark's items, by their first words."""
    asked = t.raw("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("words"))
    return t.english_index.batch(asked, 10, "or")


@query("SELECT CASE WHEN chunk_id IS NULL THEN NULL ELSE section_name END AS topic, count(*) AS found, count(CASE WHEN chunk_id % 3 = 0 THEN 1 END) AS ingested, count(CASE WHEN chunk_id % 3 = 1 THEN 1 END) AS skipped, count(CASE WHEN chunk_id % 3 = 2 THEN 1 END) AS errors FROM chunks WHERE section_name IS NOT NULL GROUP BY 1 UNION ALL SELECT 'all', count(*), count(CASE WHEN chunk_id % 3 = 0 THEN 1 END), count(CASE WHEN chunk_id % 3 = 1 THEN 1 END), count(CASE WHEN chunk_id % 3 = 2 THEN 1 END) FROM chunks WHERE section_name IS NOT NULL")
def ingest_summary(t: Tables) -> DataFrame:
    status = F.when(F.col("chunk_id") % 3 == 0, "ok").when(F.col("chunk_id") % 3 == 1, "skipped").otherwise("error")
    return storage.ingest_summary(t.chunks.filter("section_name is not null").select(F.col("section_name").alias("topic"), status.alias("status")))


@query(f"WITH {NEAR30}, {T} {RRF}")
def hybrid_rrf(t: Tables) -> DataFrame:
    return retrieval.hybrid_rrf(t.chunks, t.vector(), QUERY, 10, MODEL, index=t.word_index)


@query(f"WITH {NEAR30}, {T} {WEIGHTED}")
def hybrid_weighted(t: Tables) -> DataFrame:
    return retrieval.hybrid_weighted(t.chunks, t.vector(), QUERY, 10, MODEL, index=t.word_index)


@query(f"WITH {NEAR30}, {NONE} {WEIGHTED}")
def hybrid_weighted_no_match(t: Tables) -> DataFrame:
    return retrieval.hybrid_weighted(t.chunks, t.vector(), "zzzzqqq", 10, MODEL, index=t.word_index)


@query(f"WITH {NEAR30}, {T}, {COUNTS} {FULL}")
def full_hybrid(t: Tables) -> DataFrame:
    return joined(retrieval.full_hybrid(t.chunks, t.mentions, t.vector(), QUERY, 10, MODEL, index=t.word_index))


@query(f"WITH {NEAR30}, {T}, {COUNTS}, s1 AS (SELECT chunk_id, similarity AS final_score, similarity FROM scored ORDER BY 2 DESC, 1 LIMIT 10), s2 AS ({BOOST}), s3 AS ({RRF}), s4 AS ({FULL}) SELECT 'ivfflat_only' AS strategy, row_number() OVER (ORDER BY final_score DESC, chunk_id) AS position, chunk_id, final_score FROM s1 UNION ALL SELECT 'ivfflat_ner_boost', row_number() OVER (ORDER BY final_score DESC, similarity DESC, chunk_id), chunk_id, final_score FROM s2 UNION ALL SELECT 'ivfflat_tsvector', row_number() OVER (ORDER BY final_score DESC, chunk_id), chunk_id, final_score FROM s3 UNION ALL SELECT 'ivfflat_ner_tsvector', row_number() OVER (ORDER BY final_score DESC, chunk_id), chunk_id, final_score FROM s4")
def compare_strategies(t: Tables) -> DataFrame:
    return retrieval.compare(t.chunks, t.mentions, t.vector(), QUERY, 10, index=t.word_index, model=MODEL)


@query(f"SELECT vec_id AS mention_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {Q0}), 6) AS similarity FROM embeddings WHERE label = 3 ORDER BY similarity DESC, mention_id LIMIT 10")
def similar_mentions(t: Tables) -> DataFrame:
    e = t.raw("embeddings")
    m = e.select(F.col("vec_id").alias("mention_id"), F.col("vec_id").alias("doc_id"), F.lit("").alias("mention_text"), "label")
    return retrieval.similar_mentions(m, e.select(F.col("vec_id").alias("mention_id"), "embedding"), t.vector(), 3).select("mention_id", "label", "similarity")


@query("WITH q AS (SELECT chunk_id AS query_id, embedding AS e FROM chunks WHERE chunk_id % 20 = 0), s AS (SELECT query_id, chunk_id, round(list_cosine_similarity(embedding, e), 6) AS similarity FROM q, chunks) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM s QUALIFY rank <= 10")
def batch_topk(t: Tables) -> DataFrame:
    q = t.chunks.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.batch_nearest(t.chunks, q, 10)


BATCH = f"""q AS (SELECT chunk_id AS query_id, embedding AS e, CASE WHEN chunk_id % 40 = 0 THEN ['the', 'of'] ELSE ['de', 'la'] END AS asked FROM chunks WHERE chunk_id % 20 = 0),
  sv AS (SELECT query_id, chunk_id, round(list_cosine_similarity(embedding, e), 6) AS similarity FROM q, chunks),
  v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS vector_rank FROM sv QUALIFY vector_rank <= 30),
  w AS (SELECT chunk_id, {TERMS} AS w FROM chunks),
  st AS (SELECT query_id, chunk_id, round(CAST(len(list_filter(w, lambda x: list_contains(asked, x))) AS DOUBLE) / len(w), 6) AS text_score FROM q, w WHERE list_has_all(w, asked)),
  t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY text_score DESC, chunk_id) AS text_rank FROM st QUALIFY text_rank <= 30),
  vt AS (SELECT query_id, chunk_id, coalesce(similarity, 0) AS similarity, text_score, vector_rank, text_rank FROM v FULL JOIN t USING (query_id, chunk_id))"""


def _batch(t: Tables) -> DataFrame:
    q = t.chunks.filter("chunk_id % 20 = 0")
    return q.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"), F.when(F.col("chunk_id") % 40 == 0, " The of,").otherwise("de la de").alias("words"))


@query(f"WITH {BATCH}, f AS (SELECT query_id, chunk_id, similarity, text_score, round(1.0::DOUBLE / (60.0::DOUBLE + coalesce(vector_rank, 31)) + 1.0::DOUBLE / (60.0::DOUBLE + coalesce(text_rank, 31)), 8) AS final_score FROM vt) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, chunk_id) AS rank FROM f QUALIFY rank <= 10")
def batch_hybrid_rrf(t: Tables) -> DataFrame:
    return retrieval.batch_hybrid(t.chunks, t.mentions, _batch(t), 10, index=t.word_index)


@query(f"WITH {BATCH}, mc AS (SELECT doc_id, section_name, count(*) AS mention_count FROM mentions WHERE section_name IS NOT NULL GROUP BY ALL), f AS (SELECT query_id, vt.chunk_id, similarity, text_score, round(0.5::DOUBLE * similarity + 0.3::DOUBLE * coalesce(text_score / nullif(max(text_score) OVER (PARTITION BY query_id), 0), 0) + 0.2::DOUBLE * {NER}, 6) AS final_score FROM vt JOIN chunks c ON c.chunk_id = vt.chunk_id LEFT JOIN mc ON mc.doc_id = c.doc_id AND mc.section_name = c.section_name) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, chunk_id) AS rank FROM f QUALIFY rank <= 10")
def batch_full_hybrid(t: Tables) -> DataFrame:
    return retrieval.batch_hybrid(t.chunks, t.mentions, _batch(t), 10, fusion="weighted", index=t.word_index)


@query(f"WITH {BATCH}, mc AS (SELECT doc_id, section_name, count(*) AS n FROM mentions WHERE section_name IS NOT NULL GROUP BY ALL), f AS (SELECT query_id, v.chunk_id, similarity, coalesce(n, 0) AS mention_count, round(similarity + round(0.15::DOUBLE * least(1.0::DOUBLE, ln(1 + coalesce(n, 0)) / ln(11.0::DOUBLE)), 6), 6) AS final_score FROM v JOIN chunks c ON c.chunk_id = v.chunk_id LEFT JOIN mc ON mc.doc_id = c.doc_id AND mc.section_name = c.section_name) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, similarity DESC, chunk_id) AS rank FROM f QUALIFY rank <= 10")
def batch_ner_boost(t: Tables) -> DataFrame:
    return retrieval.batch_boost(t.chunks, t.mentions, _batch(t), 10)


@query(f"WITH {BATCH}, f AS (SELECT query_id, sv.chunk_id, similarity FROM sv JOIN chunks c ON c.chunk_id = sv.chunk_id JOIN docs d ON d.doc_id = c.doc_id WHERE year(d.year) BETWEEN 2005 AND 2020 AND d.source IN ('arXiv', 'PubMed Central')) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM f QUALIFY rank <= 10")
def batch_topk_filtered(t: Tables) -> DataFrame:
    f = flt.Filters(year_min=2005, year_max=2020, sources=["arXiv", "PubMed Central"])
    return retrieval.batch_filtered(t.chunks, t.docs, _batch(t), f, 10)


def _compared(names: dict[str, str], base: str) -> str:
    """Lists of registered batch queries, compared with the base's by sets and by ranks."""
    lists = " UNION ALL ".join(f"SELECT '{strategy}' AS strategy, query_id, chunk_id, rank FROM ({_FOUND[q][1]})" for strategy, q in names.items())
    return f"""lists AS ({lists}),
      b AS (SELECT * FROM lists WHERE strategy = '{base}'), o AS (SELECT * FROM lists WHERE strategy <> '{base}'),
      shared AS (SELECT o.strategy, query_id, count(*) AS n, CAST(sum((o.rank - b.rank) ** 2) AS DOUBLE) AS d FROM o JOIN b USING (query_id, chunk_id) GROUP BY ALL),
      sizes AS (SELECT strategy, query_id, count(*) AS n_o FROM o GROUP BY ALL), base AS (SELECT query_id, count(*) AS n_b FROM b GROUP BY ALL),
      q AS (SELECT s.strategy, round(coalesce(n, 0) / CAST(n_o + n_b - coalesce(n, 0) AS DOUBLE), 6) AS jaccard, round(CASE WHEN n >= 2 THEN 1 - 6 * d / (CAST(n AS DOUBLE) * (CAST(n AS DOUBLE) * n - 1)) ELSE 0 END, 6) AS correlation
        FROM sizes s JOIN base USING (query_id) LEFT JOIN shared t ON t.strategy = s.strategy AND t.query_id = s.query_id)
      SELECT strategy, CAST(sum(CAST(round(jaccard * 1000000) AS BIGINT)) AS DOUBLE) / count(*) / 1000000.0::DOUBLE AS avg_overlap, min(jaccard) AS min_overlap, max(jaccard) AS max_overlap, CAST(sum(CAST(round(correlation * 1000000) AS BIGINT)) AS DOUBLE) / count(*) / 1000000.0::DOUBLE AS avg_rank_correlation FROM q GROUP BY strategy"""


@query("WITH " + _compared({"ivfflat_only": "batch_topk", "ivfflat_ner_boost": "batch_ner_boost", "ivfflat_tsvector": "batch_hybrid_rrf", "ivfflat_ner_tsvector": "batch_full_hybrid"}, "ivfflat_only"))
def strategy_comparisons(t: Tables) -> DataFrame:
    """All four strategies over all the questions, stored, and compared with the first."""
    place = own_folder(t.spark, "strategies")
    for name, found in benchmark.strategy_lists(t.chunks, t.mentions, _batch(t), place, 10, t.word_index).items():
        found.drop("strategy").write.parquet(f"{place}/lists/strategy={name}")
    return benchmark.comparisons(benchmark.stored_lists(t.spark, place))


@query()
def strategy_benchmark(t: Tables) -> DataFrame:
    """A whole run over fifty sampled questions: times, numbers of results and comparisons by strategy."""
    questions = benchmark.sampled_questions(retrieval.of_model(t.chunks, MODEL), 50)
    return benchmark.table(benchmark.run(t.chunks, t.mentions, questions, own_folder(t.spark, "benchmark"), 10, MODEL, t.word_index))


@query("WITH s AS (SELECT a.chunk_id AS query_id, b.chunk_id, round(list_cosine_similarity(a.embedding, b.embedding), 6) AS similarity FROM chunks a JOIN chunks b ON a.chunk_id <> b.chunk_id WHERE a.chunk_id % 20 = 0) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM s QUALIFY rank <= 5")
def knn_self(t: Tables) -> DataFrame:
    return retrieval.self_neighbours(t.chunks, 5, every=20)


@query(f"WITH {SIM} SELECT chunk_id, doc_id, similarity FROM scored ORDER BY similarity DESC, chunk_id LIMIT 10")
def ivf_full_probe(t: Tables) -> DataFrame:
    return _ivf(t, probe_all=True)


@query()
def ivf_topk(t: Tables) -> DataFrame:
    return _ivf(t, probe_all=False)


def _ivf(t: Tables, probe_all: bool) -> DataFrame:
    n = len(t.lists.centroids)
    return t.lists.search(t.vector(), 10, n if probe_all else max(1, n // 4))


def _every_twentieth(t: Tables) -> DataFrame:
    return t.chunks.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))


@query()
def ivf_batch(t: Tables) -> DataFrame:
    """Inverted lists for many queries, with each query's measured recall of its ten true neighbours."""
    found = t.lists.search_many(_every_twentieth(t), 10, max(1, (3 * len(t.lists.centroids)) // 4))
    exact = retrieval.batch_nearest(retrieval.of_model(t.chunks, MODEL), _every_twentieth(t), 10)
    return found.join(ivf.recall(found, exact, _every_twentieth(t)), "query_id")


@query(f"WITH q AS (SELECT chunk_id AS query_id, embedding AS e FROM chunks WHERE chunk_id % 20 = 0), s AS (SELECT query_id, chunk_id, round(list_cosine_similarity(embedding, e), 6) AS similarity FROM q, chunks WHERE embedding_model = '{MODEL}') SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM s QUALIFY rank <= 10")
def ivf_batch_full_probe(t: Tables) -> DataFrame:
    """All lists of all queries: the exact neighbours, by the way that the index takes."""
    return t.lists.search_many(_every_twentieth(t), 10, len(t.lists.centroids))


@query()
def ivf_measured_sweep(t: Tables) -> DataFrame:
    """Indexes of several numbers of lists, built and searched; the recalls and times of each number of probes."""
    n = suggested_lists(t.chunks.count())
    return ivf.sweep(retrieval.of_model(t.chunks, MODEL), _every_twentieth(t), own_folder(t.spark, "sweep"), [max(2, n // 2), n], [1, n // 4, n])


# --- mentions ---------------------------------------------------------------------------------


@query("WITH g AS (SELECT label, count(*) AS mentions FROM mentions GROUP BY label UNION ALL SELECT 'all', count(*) FROM mentions) SELECT label, mentions, round(100 * mentions / (SELECT CAST(count(*) AS DOUBLE) FROM mentions), 4) AS percent FROM g")
def mention_stats(t: Tables) -> DataFrame:
    return ner.statistics(t.mentions)


@query("SELECT doc_id, mention_text, label, start_char FROM mentions WHERE doc_id = 42")
def mentions_for_doc(t: Tables) -> DataFrame:
    return retrieval.mentions_of_document(t.mentions, 42).select("doc_id", "mention_text", "label", "start_char")


@query("SELECT doc_id, mention_text, created_at FROM mentions WHERE label = 'drug' ORDER BY created_at DESC, mention_id LIMIT 100")
def mentions_by_label(t: Tables) -> DataFrame:
    return retrieval.mentions_by_label(t.mentions, "drug").select("doc_id", "mention_text", "created_at")


@query("SELECT doc_id, label, count(*) AS mentions FROM mentions GROUP BY ALL")
def label_counts(t: Tables) -> DataFrame:
    return ner.label_counts(t.mentions)


@query("WITH m AS (SELECT doc_id % 50 AS doc_id, doc_id AS chunk_index, upper(mention_text) || ' ' AS mention_text, label, section_name FROM mentions) SELECT doc_id, min(chunk_index) AS chunk_index, lower(trim(mention_text)) AS shown, label, section_name FROM m GROUP BY doc_id, lower(trim(mention_text)), label, section_name")
def dedup_mentions(t: Tables) -> DataFrame:
    m = t.mentions.select((F.col("doc_id") % 50).alias("doc_id"), F.col("doc_id").alias("chunk_index"), F.concat(F.upper("mention_text"), F.lit(" ")).alias("mention_text"), "label", "section_name")
    return ner.dedup(m, "chunk_index").select("doc_id", "chunk_index", F.lower(F.trim("mention_text")).alias("shown"), "label", "section_name")


@query()
def extract_mentions(t: Tables) -> DataFrame:
    return ner.dedup(ner.extract_mentions(t.whole_chunks, {"stupid": "disease", "license": "drug"}))


@query(r"""WITH d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM benchmark),
  w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents)
  SELECT doc_id, term AS mention_text, CASE WHEN length(term) % 2 = 0 THEN 'drug' ELSE 'disease' END AS label, count(*) AS mentions FROM w JOIN d USING (term) GROUP BY ALL""")
def dictionary_mentions(t: Tables) -> DataFrame:
    """All words of the benchmark's items as a vocabulary, found in whole texts."""
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), 0)))
    terms = {r.term: "drug" if len(r.term) % 2 == 0 else "disease" for r in t.raw("benchmark").select(words.alias("term")).distinct().limit(ner.MOST_TERMS + 1).collect()}
    texts = t.raw("documents").select("doc_id", F.lit(None).cast("string").alias("section_name"), F.lit(0).alias("chunk_index"), F.concat(F.lit("\n\n"), "text").alias("text"))
    found = ner.extract_mentions(texts, ner.Vocabulary(terms), contexts=False).filter("label_confidence = 0.8")
    return found.groupBy("doc_id", F.lower("mention_text").alias("mention_text"), "label").agg(F.count(F.lit(1)).alias("mentions"))


@query("SELECT label, count(*) AS mentions, count(DISTINCT lower(trim(mention_text))) AS texts, CAST(1 AS BIGINT) AS vectors_a_text FROM mentions GROUP BY label")
def mention_vector_coverage(t: Tables) -> DataFrame:
    """Every mention has a vector, and mentions of one text have one."""
    m = t.mentions.join(t.mention_vectors, "mention_id").groupBy("label", mention_vectors.text_key().alias("text")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("embedding").alias("vectors"))
    return m.groupBy("label").agg(F.sum("n").alias("mentions"), F.count(F.lit(1)).alias("texts"), F.max("vectors").alias("vectors_a_text"))


@query()
def mention_vector_topk(t: Tables) -> DataFrame:
    """The mentions most similar to a text, by the vectors that ingest has made."""
    asked = [float(x) for x in HashEmbedder(64).encode(["license"])[0]]
    return retrieval.similar_mentions(t.mentions, t.mention_vectors, asked, None, 20)


@query("SELECT doc_id, title FROM docs WHERE (lower(author[1]) LIKE '%mith 1%' OR lower(author[2]) LIKE '%mith 1%' OR lower(author[1]) LIKE '%en _%' OR lower(author[2]) LIKE '%en _%') AND (lower(institute) LIKE '%e de%' OR lower(institute) LIKE '%7%')")
def docs_by_names(t: Tables) -> DataFrame:
    """Documents by parts of names: found by their trigrams, one of them too short for any."""
    f = flt.Filters(authors=["mith 1", "en _"], institutions=["E DE", "7"])
    return t.names.candidates(t.docs, f).filter(flt.build(f)).select("doc_id", "title")


# --- storage and planning ---------------------------------------------------------------------


@query("SELECT doc_id FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM ids WHERE id_type = 'doi')")
def docs_without_doi(t: Tables) -> DataFrame:
    return storage.docs_without_doi(t.docs, t.ids).select("doc_id")


@query("SELECT DISTINCT doc_id FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM mentions WHERE label = 'drug')")
def docs_without_mentions(t: Tables) -> DataFrame:
    return storage.docs_without_mentions(t.chunks, t.mentions.filter("label = 'drug'"))


@query("SELECT source_id, source_id NOT IN (SELECT d.source_id FROM docs d JOIN chunks c USING (doc_id) WHERE c.embedding_model = 'other') AS todo FROM docs")
def docs_needing_update(t: Tables) -> DataFrame:
    return storage.plan(t.docs.select("source_id"), t.docs, t.chunks, "other")


@query("SELECT chunk_id, doc_id FROM chunks WHERE doc_id IN (SELECT doc_id FROM mentions WHERE label = 'disease')")
def semi_docs_with_mentions(t: Tables) -> DataFrame:
    return storage.chunks_of_docs_with_mentions(t.chunks, t.mentions.filter("label = 'disease'")).select("chunk_id", "doc_id")


@query("SELECT count(DISTINCT CASE WHEN id_type = 'doi' AND id_value NOT LIKE '10.48550/%' THEN doc_id END) AS journal, count(DISTINCT CASE WHEN id_type = 'doi' AND id_value LIKE '10.48550/%' THEN doc_id END) AS arxiv, count(DISTINCT CASE WHEN id_type = 'doi' THEN doc_id END) AS total FROM ids")
def doi_counts(t: Tables) -> DataFrame:
    return storage.doi_counts(t.ids)


@query("""WITH n AS (SELECT doc_id, 'arxiv-doi' AS id_type, '10.48550/arXiv.2401.' || doc_id AS id_value FROM docs WHERE doc_id > 40 AND source = 'arXiv'
    UNION ALL SELECT doc_id, 'doi', '10.1000/j' || (doc_id - doc_id % 2) FROM docs WHERE doc_id > 40 AND doc_id % 5 <> 0)
  SELECT doc_id, id_type, id_value FROM ids UNION ALL SELECT min(doc_id), id_type, id_value FROM n WHERE NOT EXISTS (SELECT 1 FROM ids i WHERE i.id_type = n.id_type AND lower(i.id_value) = lower(n.id_value)) GROUP BY id_type, id_value""")
def enrich_dois(t: Tables) -> DataFrame:
    i = F.col("doc_id")
    d = t.docs.select("doc_id", "source", F.concat(F.lit("2401."), i.cast("string")).alias("source_id"), F.when(i % 5 != 0, F.concat(F.lit("https://doi.org/10.1000/j"), (i - i % 2).cast("string"))).alias("doi"), F.lit(None).cast("string").alias("source_uri"))
    return storage.enrich(t.spark, d, t.ids, 40)[0]


@query("SELECT doc_id FROM docs ORDER BY doc_id DESC LIMIT 100")
def newest_docs(t: Tables) -> DataFrame:
    return storage.newest(t.docs, 100)


@query("SELECT max(doc_id) AS max_doc_id FROM docs")
def max_doc_id(t: Tables) -> DataFrame:
    return storage.high_water_mark(t.docs)


@query("SELECT doc_id FROM docs WHERE doc_id > 150")
def new_since_mark(t: Tables) -> DataFrame:
    return storage.new_since(t.docs, 150)


@query("SELECT doc_id, embedding_model, count(*) AS chunks FROM chunks GROUP BY ALL")
def chunk_counts_by_model(t: Tables) -> DataFrame:
    return storage.chunk_counts_by_model(t.chunks)


@query("SELECT d.doc_id, count(c.chunk_id) AS chunks FROM docs d LEFT JOIN chunks c USING (doc_id) GROUP BY d.doc_id")
def chunks_per_doc(t: Tables) -> DataFrame:
    return storage.chunks_per_doc(t.docs, t.chunks)


@query("SELECT count(*) AS total, count(CASE WHEN section_name IS NOT NULL THEN text END) AS with_text FROM chunks")
def coverage_report(t: Tables) -> DataFrame:
    return storage.coverage(t.chunks.withColumn("text", F.when(F.col("section_name").isNotNull(), F.col("text"))))


@query("""WITH o AS (SELECT doc_id, ext_id, title, institute FROM docs WHERE doc_id % 2 = 0),
  n AS (SELECT ext_id, CASE WHEN doc_id % 3 <> 0 THEN 'New ' || doc_id END AS title, CAST(NULL AS VARCHAR) AS institute FROM docs WHERE doc_id % 5 = 0)
  SELECT o.doc_id, ext_id, coalesce(n.title, o.title) AS title, coalesce(n.institute, o.institute) AS institute, o.doc_id IS NULL AS is_new FROM o FULL JOIN n USING (ext_id)""")
def upsert_documents(t: Tables) -> DataFrame:
    old = t.docs.filter("doc_id % 2 = 0").select("doc_id", "ext_id", "title", "institute")
    new = t.docs.filter("doc_id % 5 = 0").select("ext_id", F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("New "), F.col("doc_id").cast("string"))).alias("title"), F.lit(None).cast("string").alias("institute"))
    top = old.agg(F.max("doc_id").alias("top"))
    up = storage.upsert_documents(old, new).join(F.broadcast(top))
    return up.select(F.when(F.col("doc_id") <= F.col("top"), F.col("doc_id")).alias("doc_id"), "ext_id", "title", "institute", (F.col("doc_id") > F.col("top")).alias("is_new"))


@query("""WITH o AS (SELECT doc_id, title, institute FROM docs WHERE doc_id % 2 = 0),
  n AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'New ' || doc_id END AS title, CASE WHEN doc_id % 3 = 0 THEN 'New institute' END AS institute FROM docs WHERE doc_id // 100 % 10 = 3)
  SELECT doc_id, coalesce(n.title, o.title) AS title, coalesce(n.institute, o.institute) AS institute FROM o FULL JOIN n USING (doc_id)""")
def upsert_in_place(t: Tables) -> DataFrame:
    """New rows in two parts a key, one null where the other has the value; keys lie in a tenth of the buckets, which alone are written; twice."""
    rows = t.docs.select("doc_id", "title", "institute")
    table = tables.KeyedTable.create(rows.filter("doc_id % 2 = 0"), f"{own_folder(t.spark, 'keyed')}/docs", tables.by_range("doc_id", 100))
    near = rows.filter("doc_id div 100 % 10 = 3")
    none = F.lit(None).cast("string")
    titles = near.select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("New "), F.col("doc_id").cast("string"))).alias("title"), none.alias("institute"))
    places = near.select("doc_id", none.alias("title"), F.when(F.col("doc_id") % 3 == 0, F.lit("New institute")).alias("institute"))
    for _ in range(2):
        table.upsert(titles.unionByName(places), ["doc_id"])
    return table.rows()


@query("""WITH o AS (SELECT doc_id, chunk_index, 'old' AS text FROM chunks UNION ALL SELECT doc_id, chunk_index + 1, 'old' FROM chunks),
  n AS (SELECT doc_id, chunk_index, 'new' AS text FROM chunks WHERE doc_id % 3 = 0)
  SELECT doc_id, chunk_index, text FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc_id = o.doc_id AND n.chunk_index = o.chunk_index) UNION ALL SELECT * FROM n""")
def upsert_chunks(t: Tables) -> DataFrame:
    c = t.chunks.select("doc_id", "chunk_index")
    old = c.withColumn("text", F.lit("old")).unionByName(c.select("doc_id", (F.col("chunk_index") + 1).alias("chunk_index"), F.lit("old").alias("text")))
    return storage.upsert_chunks(old, c.filter("doc_id % 3 = 0").withColumn("text", F.lit("new")))


@query("SELECT chunk_id, doc_id, embedding_model FROM chunks WHERE NOT (embedding_model = 'other' AND doc_id % 4 = 1)")
def purge_chunks(t: Tables) -> DataFrame:
    return storage.purge_chunks(t.chunks, t.docs.filter("doc_id % 4 = 1"), "other").select("chunk_id", "doc_id", "embedding_model")


@query("""WITH n AS (SELECT doc_id, 'doi' AS id_type, '10.1000/j' || (doc_id - doc_id % 2) AS id_value FROM docs)
  SELECT doc_id, id_type, id_value FROM ids UNION ALL SELECT min(doc_id), id_type, id_value FROM n WHERE lower(id_value) NOT IN (SELECT lower(id_value) FROM ids WHERE id_type = 'doi') GROUP BY id_type, id_value""")
def insert_ids_if_absent(t: Tables) -> DataFrame:
    i = F.col("doc_id")
    return storage.insert_ids(t.ids, t.docs.select("doc_id", F.lit("doi").alias("id_type"), F.concat(F.lit("10.1000/j"), (i - i % 2).cast("string")).alias("id_value")))


# --- facets -----------------------------------------------------------------------------------


@query("SELECT DISTINCT source FROM docs")
def facet_sources(t: Tables) -> DataFrame:
    return facets.sources(t.docs)


@query("SELECT min(year(year)) AS min_year, max(year(year)) AS max_year FROM docs")
def facet_years(t: Tables) -> DataFrame:
    return facets.year_range(t.docs)


@query("SELECT count(*) AS document_count FROM docs")
def facet_count(t: Tables) -> DataFrame:
    return facets.document_count(t.docs)


@query("SELECT name, count(*) AS document_count FROM (SELECT unnest(author) AS name FROM docs) GROUP BY name ORDER BY 2 DESC, 1 LIMIT 20")
def facet_authors(t: Tables) -> DataFrame:
    return facets.top_authors(t.docs)


@query("SELECT institute AS name, count(*) AS document_count FROM docs WHERE institute IS NOT NULL GROUP BY name ORDER BY 2 DESC, 1 LIMIT 20")
def facet_institutions(t: Tables) -> DataFrame:
    return facets.top_institutions(t.docs)


# --- text and identifiers ---------------------------------------------------------------------


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w FROM documents),
  i AS (SELECT doc_id, w, unnest(range(0, len(w), 510)) AS s FROM w)
  SELECT doc_id, CAST(s // 510 AS INTEGER) AS chunk_index, sha256(array_to_string(w[s + 1 : s + 600], ' ')) AS content_hash, substr(array_to_string(w[s + 1 : s + 600], ' '), 1, 40) AS preview FROM i""")
def chunk_by_tokens(t: Tables) -> DataFrame:
    d = t.raw("documents").select("doc_id", F.posexplode(tx.chunk_by_tokens(F.col("text"), 600, 90)).alias("chunk_index", "c"))
    return d.select("doc_id", "chunk_index", tx.content_hash(F.col("c")).alias("content_hash"), tx.preview(F.col("c"), 40).alias("preview"))


@query(r"""WITH f AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\n+', ' ', 'g'), '([.?!])\s+([A-Z0-9(])', '\1' || chr(1) || '\2', 'g') AS t FROM documents),
  g AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(t, '([.?!])\s+([A-Z0-9(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM f),
  i AS (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS k FROM g)
  SELECT doc_id, CAST(k - 1 AS INTEGER) AS ordinal, s[k] AS sentence FROM i""")
def sentence_split(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("ordinal", "sentence"))


@query("SELECT doc_id, sha256(text) AS content_hash, substr(text, 1, 500) AS preview FROM documents")
def content_hash(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"), tx.preview(F.col("text")).alias("preview"))


@query("SELECT chunk_id, 'PMC' || doc_id AS pmcid, chunk_index, 1200 AS chunk_tokens, 150 AS chunk_overlap, 'm' AS embedding_model, section_name FROM chunks")
def chunk_metadata_json(t: Tables) -> DataFrame:
    named = t.chunks.select("chunk_id", "chunk_index", "section_name", F.concat(F.lit("PMC"), F.col("doc_id").cast("string")).alias("source_id"))
    m = F.from_json(storage.chunk_metadata(1200, 150, "m"), "pmcid string, chunk_index int, chunk_tokens int, chunk_overlap int, embedding_model string, section_name string")
    return named.select("chunk_id", m.alias("m")).select("chunk_id", "m.*")


@query(r"SELECT doc_id, lower(regexp_replace(trim('  https://DOI.org/10.1109/ABC' || doc_id || ' '), '(?i)^https?://(dx\.)?doi\.org/', '')) AS doi, '10.48550/arXiv.2401.' || doc_id AS arxiv_doi, '2401.' || doc_id AS arxiv FROM docs")
def doi_normalize(t: Tables) -> DataFrame:
    s = F.col("doc_id").cast("string")
    raw = F.concat(F.lit("arXiv:2401."), s, F.lit("v2"))
    return t.docs.select("doc_id", ident.doi(F.concat(F.lit("  https://DOI.org/10.1109/ABC"), s, F.lit(" "))).alias("doi"), ident.arxiv_doi(raw).alias("arxiv_doi"), ident.arxiv_id(raw).alias("arxiv"))


@query(r"SELECT page_id, lower(regexp_replace(trim(url || '//'), '/+$', '')) AS uri FROM pages")
def uri_normalize(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", ident.uri(F.concat("url", F.lit("//"))).alias("uri"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'r' || doc_id ELSE substr(md5(title), 1, 16) END AS scholar_id, CASE WHEN doc_id % 5 <> 0 THEN make_date(1990 + doc_id % 30, 1, 1) END AS year, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'A;B' || doc_id END AS authors FROM docs")
def scholar_fields(t: Tables) -> DataFrame:
    i, s = F.col("doc_id"), F.col("doc_id").cast("string")
    summary = F.when(i % 5 != 0, F.concat(F.lit("J Test, "), (F.lit(1990) + i % 30).cast("string"), F.lit(" - x"))).otherwise(F.lit("no date 12345"))
    names = F.when(i % 3 == 0, F.lit(" ; ")).otherwise(F.concat(F.lit("A; ;B"), s, F.lit(" ;")))
    return t.docs.select("doc_id", ident.scholar_id(F.when(i % 2 == 0, F.concat(F.lit("r"), s)), F.col("title")).alias("scholar_id"), ident.year_of(summary).alias("year"), F.array_join(ident.authors(names), ";").alias("authors"))


@query("SELECT doc_id, 'PMC' || doc_id || '#3,PMC7#2' AS cited FROM docs WHERE doc_id <> 7 UNION ALL SELECT 7, 'PMC7#3,PMC7#2'")
def parse_citations(t: Tables) -> DataFrame:
    s = F.col("doc_id").cast("string")
    answer = F.concat(F.lit("x [PMC"), s, F.lit("#3] y [pmc"), s, F.lit(":3] [PMCID:4] [arXiv:1.2#1] [PMC7; PMC8 #2]"))
    shown = F.transform(ident.citations(answer), lambda c: F.concat(c["doc"], F.lit("#"), c["idx"].cast("string")))
    return t.docs.select("doc_id", F.array_join(shown, ",").alias("cited"))


@query(f"WITH {SIM}, h AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, chunk_id) AS rank FROM scored QUALIFY rank <= 5) SELECT string_agg('[' || CASE doc_id % 3 WHEN 0 THEN 'PMC' || doc_id WHEN 1 THEN '2401.' || doc_id ELSE 's' || doc_id END || '#' || chunk_index || '] ' || text, chr(10) || chr(10) ORDER BY rank) AS context FROM h")
def prompt(t: Tables) -> DataFrame:
    hits = retrieval.contexts(retrieval.vector_only(t.chunks, t.vector(), 5, MODEL), t.chunks, t.docs)
    return prompt_context(hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "chunk_id"))))


ASKED = f"""q AS (SELECT item_id AS query_id, b.text AS question, CAST(embedding AS DOUBLE[]) AS e FROM benchmark b JOIN embeddings ON vec_id = item_id),
  s AS (SELECT query_id, chunk_id, doc_id, chunk_index, text, round(list_cosine_similarity(embedding, e), 6) AS similarity FROM q, chunks WHERE embedding_model = '{MODEL}'),
  h AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'PMC' || doc_id WHEN 1 THEN '2401.' || doc_id ELSE 's' || doc_id END AS doc_ref,
    row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM s QUALIFY rank <= 5),
  b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS told FROM h WHERE regexp_matches(text, '^[^\\n]') QUALIFY told <= 3),
  a AS (SELECT query_id, string_agg(trim(string_split(regexp_extract(text, '^[^\\n]+'), '. ')[1], '. ') || '. [' || doc_ref || '#' || chunk_index || ']', ' ' ORDER BY rank) AS answer,
    string_agg(doc_ref || '#' || chunk_index, ';' ORDER BY rank) FILTER (doc_ref LIKE 'PMC%') AS named FROM b GROUP BY query_id)
  SELECT a.query_id, answer, (SELECT count(*) FROM h x WHERE x.query_id = a.query_id) AS n_contexts, coalesce(named, h.doc_ref || '#' || h.chunk_index) AS cited
  FROM a JOIN h ON h.query_id = a.query_id AND h.rank = 1"""


@query(f"WITH {ASKED}")
def batch_answers(t: Tables) -> DataFrame:
    """The benchmark's items as questions, all in one plan: passages, the extractive generator, citations or else the first passage."""
    vectors = t.raw("embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    asked = t.raw("benchmark").join(vectors, "item_id").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), "vector")
    told = answers.answer_many(asked, t.chunks, t.docs, ExtractiveGenerator(), 5, model=MODEL)
    shown = F.transform("citations", lambda c: F.concat(c["doc_ref"], F.lit("#"), c["chunk_index"].cast("string")))
    return told.select("query_id", "answer", "n_contexts", F.array_join(shown, ";").alias("cited"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[^ -~]', ' ', 'g'), '\b(eren\w*)\b', '<mark>\1</mark>', 'gi'), '\b(tion\w*)\b', '<mark>\1</mark>', 'gi') AS shown FROM p")
def highlight(t: Tables) -> DataFrame:
    """Over ASCII, since RE2 and Java part words differently beyond it."""
    return t.docs_with_text.select("doc_id", tx.highlight(F.regexp_replace("text", "[^ -~]", " "), "What eren tion with").alias("shown"))


@query("WITH s AS (SELECT doc_id % 20 AS d, doc_id AS i, length(text) AS n FROM p), r AS (SELECT *, sum(n) OVER (PARTITION BY d ORDER BY i) AS upto FROM s) SELECT d, i, greatest(0, least(n, 2000 - (upto - n))) AS taken FROM r WHERE 2000 - (upto - n) > 0".replace("greatest(0, least(n, 2000 - (upto - n)))", "CAST(greatest(0, least(n, 2000 - (upto - n))) AS BIGINT)"))
def char_budget(t: Tables) -> DataFrame:
    s = t.docs_with_text.select((F.col("doc_id") % 20).alias("d"), F.col("doc_id").alias("i"), F.length("text").cast("long").alias("n"))
    r = s.withColumn("upto", F.sum("n").over(Window.partitionBy("d").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return r.select("d", "i", tx.char_budget(F.col("n"), F.col("upto"), 2000).alias("taken")).filter("taken > 0")


@query("SELECT doc_id, 'a' || doc_id || '; b' AS shown FROM docs")
def ordered_dedup(t: Tables) -> DataFrame:
    s = F.col("doc_id").cast("string")
    return t.docs.select("doc_id", F.array_join(tx.ordered_distinct(F.array(F.concat(F.lit(" a"), s), F.lit("b"), F.concat(F.lit("A"), s), F.lit(" "), F.lit("B "))), "; ").alias("shown"))


@query("SELECT item_id, split_part(substr(text, 1, 150), '.', 1) || '.' AS q FROM benchmark WHERE length(split_part(substr(text, 1, 150), '.', 1) || '.') > 20")
def query_synthesis(t: Tables) -> DataFrame:
    return t.raw("benchmark").select("item_id", tx.synthesized_query(F.col("text")).alias("q")).filter(F.length("q") > 20)


@query()
def section_chunks(t: Tables) -> DataFrame:
    return chunk_documents(t.raw("documents"), 200, 20).drop("full_text")


@query()
def parse_html(t: Tables) -> DataFrame:
    return parsing.html_pages(t.raw("pages"))


# --- payloads of outside services, made from the documents --------------------------------------


def _payloads(t: Tables, payload) -> DataFrame:
    """id and a payload a document; `payload` makes it from the id as text."""
    return t.docs.select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("doc_id"), payload(F.col("doc_id").cast("string")).alias("payload"))


def _fill(form: str):
    """A payload with the id in place of each @."""
    return lambda i: F.replace(F.lit(form), F.lit("@"), i)


BIOC = '{"collection": {"documents": [{"id": "@", "infons": {"authors": "Ann A; Bo B"}, "passages": [{"text": "Title @", "infons": {"type": "title"}}, {"text": " ", "infons": {"type": "para"}}, {"text": "Some Place", "infons": {"type": "affiliation"}}, {"text": "Methods", "infons": {"type": "Section"}}, {"text": "In 2007 we saw @.", "infons": {"section_type": "BODY", "year": "2011", "author": "bo b, Cy C"}}]}]}}'


@query("SELECT doc_id, ['PMC' || doc_id, 'PMC7'] AS ids FROM docs")
def esearch_ids(t: Tables) -> DataFrame:
    return _payloads(t, _fill('{"esearchresult": {"idlist": ["@", "7"]}}')).select("doc_id", parsing.esearch_ids(F.col("payload")).alias("ids"))


@query("SELECT doc_id, '(q' || doc_id || ') AND 2001:2100[dp]' AS term, '25' AS retmax FROM docs")
def esearch_requests(t: Tables) -> DataFrame:
    r = t.docs.select("doc_id", requests.esearch_request(F.concat(F.lit("q"), F.col("doc_id").cast("string")), 25, first=2001).alias("r"))
    return r.select("doc_id", F.col("r")["term"].alias("term"), F.col("r")["retmax"].alias("retmax"))


@query("WITH s AS (SELECT doc_id, unnest(range(0, 250, 100)) AS start FROM docs) SELECT doc_id, CAST(start / 100 AS INTEGER) AS page, CAST(start AS INTEGER) AS start, CAST(least(100, 250 - start) AS INTEGER) AS size, 'all:' || doc_id AS search_query, CAST(start AS VARCHAR) AS asked FROM s")
def atom_pages(t: Tables) -> DataFrame:
    p = requests.page_starts(t.docs.select("doc_id", F.concat(F.lit("all:"), F.col("doc_id").cast("string")).alias("query")), 250, 100)
    r = p.withColumn("r", requests.atom_request(F.col("query"), F.col("start")))
    return r.select("doc_id", "page", "start", "size", F.col("r")["search_query"].alias("search_query"), F.col("r")["start"].alias("asked"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, 1 AS documents, 5 AS passages FROM docs")
def bioc_counts(t: Tables) -> DataFrame:
    return parsing.bioc_counts(_payloads(t, _fill(BIOC)))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, 0 AS ordinal, 'title' AS kind, 'Title ' || doc_id AS text FROM docs UNION ALL SELECT CAST(doc_id AS VARCHAR), 1, 'heading', 'Methods' FROM docs UNION ALL SELECT CAST(doc_id AS VARCHAR), 2, 'para', 'In 2007 we saw ' || doc_id || '.' FROM docs")
def bioc_blocks(t: Tables) -> DataFrame:
    return parsing.bioc_blocks(_payloads(t, _fill(BIOC)))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, 'Title ' || doc_id AS title, DATE '2011-01-01' AS year, 'Some Place' AS institutes, 'Ann A;Bo B;Cy C' AS authors FROM docs")
def bioc_meta(t: Tables) -> DataFrame:
    # The title's number must not look like a year.
    plain = _payloads(t, lambda i: F.replace(F.lit(BIOC), F.lit("Title @"), F.concat(F.lit("Title x"), i)))
    m = parsing.bioc_meta(plain.withColumn("payload", F.replace("payload", F.lit("saw @"), F.lit("saw it"))))
    return m.select("id", F.replace("title", F.lit("x"), F.lit("")).alias("title"), "year", "institutes", F.array_join("authors", ";").alias("authors"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'PMC' || doc_id WHEN 1 THEN 'PMC9' || doc_id END AS pmcid FROM docs")
def pmcid_resolution(t: Tables) -> DataFrame:
    i = F.col("doc_id")
    p = _payloads(t, _fill('{"records": [{"pmcid": "PMC9@"}]}')).withColumn("payload", F.when(i % 3 == 1, F.col("payload")).otherwise(F.lit('{"records": []}')))
    raw = F.when(i % 3 == 0, F.concat(F.lit(" pmc"), F.col("id"))).otherwise(F.col("id"))
    return p.select("doc_id", ident.pmcid(raw, parsing.idconv_pmcid(F.col("payload"))).alias("pmcid"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '10.1/a' || doc_id WHEN 1 THEN '10.2/b' || doc_id ELSE '10.3/c' || doc_id END AS doi FROM docs")
def journal_dois(t: Tables) -> DataFrame:
    i, s = F.col("doc_id"), F.col("doc_id").cast("string")
    cross = F.when(i % 3 == 0, _fill('{"message": {"relation": {"is-preprint-of": [{"DOI": "10.1/A@"}], "has-version": [{"DOI": "10.9/z"}]}}}')(s)).when(i % 3 == 1, _fill('{"message": {"relation": {"has-version": [{"DOI": "10.2/B@"}]}}}')(s)).otherwise(F.lit("{}"))
    data = _fill('{"data": {"attributes": {"relatedIdentifiers": [{"relationType": "References", "relatedIdentifier": "10.8/y"}, {"relationType": "IsVersionOf", "relatedIdentifier": "10.3/C@"}]}}}')(s)
    return t.docs.select("doc_id", parsing.journal_doi(cross, data).alias("doi"))


@query("SELECT doc_id, CAST(doc_id AS BIGINT) AS a FROM docs")
def lenient_payloads(t: Tables) -> DataFrame:
    p = t.docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, _fill('{"a": @}')(F.col("doc_id").cast("string"))).otherwise(_fill('callback({"a": @});')(F.col("doc_id").cast("string"))).alias("payload"))
    return p.select("doc_id", parsing.lenient_json(F.col("payload"), "a long")["a"].alias("a"))


@query("SELECT 'r' || doc_id AS scholar_id, 'T' || doc_id AS title, 'A;B' AS authors, DATE '2015-01-01' AS year, 'http://p/' || doc_id AS pdf_url FROM docs")
def scholar_pages(t: Tables) -> DataFrame:
    form = '{"organic_results": [{"result_id": "r@", "title": "T@", "publication_info": {"authors": [{"name": "A"}, {"name": " b "}, {"name": "B"}], "summary": "X - J, 2015"}, "resources": [{"file_format": "HTML", "link": "x"}, {"file_format": "pdf", "link": "http://p/@"}]}]}'
    r = parsing.scholar_results(_payloads(t, _fill(form)).withColumn("page", F.col("doc_id").cast("int")))
    return r.select("scholar_id", "title", F.upper(F.array_join("authors", ";")).alias("authors"), "year", "pdf_url")


@query("SELECT '2401.' || doc_id AS arxiv_id, 'On ' || doc_id AS title, 'Ann A;Bo B' AS authors, DATE '2024-01-02' AS published, CASE WHEN doc_id % 2 = 0 THEN '10.5/x' || doc_id ELSE '10.48550/arXiv.2401.' || doc_id END AS doi FROM docs")
def atom_feed(t: Tables) -> DataFrame:
    form = '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:x="http://arxiv.org/schemas/atom"><entry><id>http://arxiv.org/abs/2401.@v2</id><title>On\n @</title><summary>s</summary><author><name>Ann A</name></author><author><name>Bo  B</name></author><published>2024-01-02T00:00:00Z</published>$</entry></feed>'
    p = _payloads(t, _fill(form)).withColumn("payload", F.replace("payload", F.lit("$"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<x:doi>10.5/X"), "id", F.lit("</x:doi>"))).otherwise(F.lit(""))))
    return parsing.atom_entries(p).select("arxiv_id", "title", F.array_join("authors", ";").alias("authors"), "published", "doi")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, 'title:T' || doc_id || '|heading:H|para:First.|bullet:one|para:Loose.' AS shown, 'A B' AS authors, DATE '2009-01-01' AS year, '10.7/q' || doc_id AS doi FROM docs")
def nxml_articles(t: Tables) -> DataFrame:
    form = '<a:article xmlns:a="u"><title-group><article-title>T@</article-title></title-group><article-id pub-id-type="doi">10.7/Q@</article-id><contrib contrib-type="author"><name><surname>B</surname><given-names>A</given-names></name></contrib><pub-date pub-type="epub"><year>2008</year></pub-date><pub-date pub-type="ppub"><year>2009</year></pub-date><body><p>Loose.</p><sec><title>H</title><p>First.</p><list><list-item>one</list-item></list></sec></body></a:article>'
    d = parsing.nxml_documents(_payloads(t, _fill(form)))
    return d.select("id", F.array_join(F.transform("blocks", lambda b: F.concat(b["kind"], F.lit(":"), b["text"])), "|").alias("shown"), F.array_join("authors", ";").alias("authors"), "year", "doi")


@query("SELECT doc_id, '10.1234/ab.' || doc_id AS found, 'all:\"heart attack\" AND (all:\"statin\" OR all:\"d' || doc_id || '\")' AS asked FROM docs")
def doi_and_query(t: Tables) -> DataFrame:
    s = F.col("doc_id").cast("string")
    asked = F.concat(F.lit('("open access"[filter]) "heart attack" AND (statin OR d'), s, F.lit(") (2001:2009[dp])"))
    return t.docs.select("doc_id", ident.find_doi(F.concat(F.lit("see 10.1234/AB."), s, F.lit(", p. 3"))).alias("found"), ident.sanitize_arxiv_query(asked).alias("asked"))


# --- files, schema rules, small functions -------------------------------------------------------


@query("SELECT CAST(doc_id AS VARCHAR) AS id FROM docs WHERE doc_id % 3 <> 0")
def id_lists(t: Tables) -> DataFrame:
    place, s = f"{own_folder(t.spark, 'ids')}/rows", F.col("doc_id").cast("string")
    t.docs.select(F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("  "), s, F.lit("\t"))).otherwise(F.lit("  ")).alias("value")).write.text(place)
    return files.id_list(t.spark, place)


@query("WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source), r AS (SELECT source AS query, unnest(range(least(n, 100))) AS position FROM n) SELECT query, CAST(position // 30 AS INTEGER) AS page, position, query || '#' || position AS payload FROM r")
def paged_search(t: Tables) -> DataFrame:
    """Each source as a query of a paged service that has as many results as the source has documents; the first hundred, by pages of thirty."""
    totals = {r.source: r["count"] for r in t.raw("documents").groupBy("source").count().collect()}
    paged.register(t.spark)
    options = {"queries": json.dumps(sorted(totals)), "fetcher_options": json.dumps({"totals": totals}), "limit": "100", "page_size": "30", "pages_a_task": "2"}
    return t.spark.read.format("paged_search").options(**options).load()


@query("SELECT doc_id, title, list_extract(author, 1) AS first FROM docs")
def json_round_trip(t: Tables) -> DataFrame:
    place = f"{own_folder(t.spark, 'json')}/rows"
    files.write_json(t.docs.select("doc_id", "title", "author"), place)
    return files.json_lines(t.spark, place, "doc_id long, title string, author array<string>").select("doc_id", "title", F.col("author")[0].alias("first"))


@query("SELECT doc_id, '[\"' || author[1] || '\",\"' || author[2] || '\"]' AS author FROM docs")
def csv_round_trip(t: Tables) -> DataFrame:
    place = f"{own_folder(t.spark, 'csv')}/rows"
    files.write_csv(t.docs.select("doc_id", "author"), place)
    return t.spark.read.option("header", True).option("escape", "\\").schema("doc_id long, author string").csv(place)


@query("""WITH o AS (SELECT doc_id, ext_id, title, institute FROM docs WHERE doc_id % 2 = 0),
  n AS (SELECT ext_id, 'New ' || doc_id AS title, 'Institute of ' || doc_id AS institute FROM docs WHERE doc_id % 5 = 0)
  SELECT o.doc_id, ext_id, coalesce(n.title, o.title) AS title, coalesce(n.institute, o.institute) AS institute FROM o FULL JOIN n USING (ext_id)""")
def upsert_repeated_rows(t: Tables) -> DataFrame:
    """Two new rows an ext_id, each with one of two values: both hold."""
    old = t.docs.filter("doc_id % 2 = 0").select("doc_id", "ext_id", "title", "institute")
    new, none, i = t.docs.filter("doc_id % 5 = 0"), F.lit(None).cast("string"), F.col("doc_id").cast("string")
    titles = new.select("ext_id", F.concat(F.lit("New "), i).alias("title"), none.alias("institute"))
    up = storage.upsert_documents(old, titles.unionByName(new.select("ext_id", none.alias("title"), F.concat(F.lit("Institute of "), i).alias("institute"))))
    top = F.broadcast(old.agg(F.max("doc_id").alias("top")))
    return up.join(top).select(F.when(F.col("doc_id") <= F.col("top"), F.col("doc_id")).alias("doc_id"), "ext_id", "title", "institute")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN start_char END AS start_char, mention_text, label FROM mentions")
def append_mentions_null_spans(t: Tables) -> DataFrame:
    """Mentions half of which have no span, added to themselves: nothing is added."""
    m = t.mentions.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("start_char")).alias("start_char"), F.lit(None).cast("long").alias("end_char"), "mention_text", "label")
    return storage.append_mentions(m, m.unionByName(m)).select("doc_id", "start_char", "mention_text", "label")


@query("SELECT doc_id, mention_text, label FROM mentions WHERE label <> 'drug' UNION ALL SELECT doc_id, 'x', 'drug' FROM docs WHERE doc_id % 9 = 0")
def append_mentions(t: Tables) -> DataFrame:
    """Mentions that are there already are not added again, nor those that the rules of the table refuse."""
    from ..schemas import valid_mentions

    m = t.mentions.select("doc_id", "mention_text", "label", F.col("start_char"), (F.col("start_char") + F.length("mention_text")).alias("end_char"))
    old = m.filter("label <> 'drug'")
    fresh = t.docs.filter("doc_id % 9 = 0").select("doc_id", F.lit("x").alias("mention_text"), F.lit("drug").alias("label"), F.lit(0).cast("long").alias("start_char"), F.lit(1).cast("long").alias("end_char"))
    odd = fresh.withColumn("label", F.lit("no label"))
    return storage.append_mentions(old, valid_mentions(old.unionByName(fresh).unionByName(fresh).unionByName(odd))).select("doc_id", "mention_text", "label")


@query("SELECT doc_id, title FROM docs WHERE doc_id IN (3, 5, 70) AND length(text) > 100")
def docs_by_id(t: Tables) -> DataFrame:
    return t.docs_with_text.filter(flt.build(flt.Filters(doc_ids=[3, 5, 70])) & flt.usable_text()).select("doc_id", "title")


@query("SELECT doc_id, chunk_id FROM chunks WHERE chunk_index < 2")
def capped_chunks(t: Tables) -> DataFrame:
    return storage.capped(t.chunks, 2).select("doc_id", "chunk_id")


@query("SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) AS BIGINT) AS words FROM documents")
def token_counts(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", tx.token_count(F.col("text")).alias("words"))


@query("SELECT strategy, round(1.96::DOUBLE * sqrt(p * (1 - p) / n), 9) AS margin FROM (SELECT strategy, avg(CASE WHEN len(clicked_chunk_ids) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p, count(*) AS n FROM log GROUP BY strategy)")
def click_margin(t: Tables) -> DataFrame:
    g = t.log.groupBy("strategy").agg(F.avg(F.when(F.size("clicked_chunk_ids") > 0, 1.0).otherwise(0.0)).alias("p"), F.count(F.lit(1)).alias("n"))
    return g.select("strategy", F.round(ev.margin(F.col("p"), F.col("n")), 9).alias("margin"))


@query("SELECT vec_id, round(list_sum(list_transform(e, lambda x: x / norm)), 6) AS total FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS norm FROM embeddings)")
def normalized_vectors(t: Tables) -> DataFrame:
    v = t.raw("embeddings").select("vec_id", vec.normalize(vec.as_double("embedding")).alias("e"))
    return v.select("vec_id", F.round(F.aggregate("e", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("WITH w AS (SELECT doc_id, unnest(['studi', 'hors']) AS lexeme FROM docs) SELECT doc_id, lexeme, CASE lexeme WHEN 'studi' THEN '1,4' ELSE '2' END AS places FROM w")
def lexeme_vectors(t: Tables) -> DataFrame:
    d = t.docs.select("doc_id", F.lit("Studies, horses the STUDY.").alias("text"))
    v = fulltext.with_vector(d).select("doc_id", F.explode("text_tsv").alias("x"))
    return v.select("doc_id", "x.lexeme", F.array_join(F.col("x.positions").cast("array<string>"), ",").alias("places"))


@query(f"WITH {BATCH}, f AS (SELECT query_id, chunk_id, similarity, text_score, round(1.0::DOUBLE / (60.0::DOUBLE + coalesce(vector_rank, 31)) + 1.0::DOUBLE / (60.0::DOUBLE + coalesce(text_rank, 31)), 8) AS final_score FROM (SELECT query_id, chunk_id, similarity, CAST(NULL AS DOUBLE) AS text_score, vector_rank, CAST(NULL AS BIGINT) AS text_rank FROM v)) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, chunk_id) AS rank FROM f QUALIFY rank <= 10")
def batch_hybrid_stop_words(t: Tables) -> DataFrame:
    """Stemmed full text drops stop words: a query of nothing else matches no chunk, and vectors decide alone."""
    return retrieval.batch_hybrid(t.chunks, t.mentions, _batch(t).withColumn("words", F.lit("The of and")), 10, rank="stems")


# --- experiments ------------------------------------------------------------------------------


@query("SELECT user_id, CASE CAST(('0x' || substr(md5(CAST(user_id AS VARCHAR)), 32, 1)) AS INTEGER) % 4 WHEN 0 THEN 'ivfflat_only' WHEN 1 THEN 'ivfflat_ner_boost' WHEN 2 THEN 'ivfflat_tsvector' ELSE 'ivfflat_ner_tsvector' END AS strategy FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS user_id FROM events)")
def ab_assign(t: Tables) -> DataFrame:
    e = experiments.Experiment()
    for s in retrieval.STRATEGIES:
        e.register(s)
    return e.assign(t.log.select("user_id").distinct()).select("user_id", "strategy")


@query("SELECT strategy, count(*) AS queries, round(sum(latency_ms) / count(*), 6) AS avg_latency_ms, round(sum(len(clicked_chunk_ids)) / CAST(count(*) AS DOUBLE), 6) AS click_through, round(avg(CASE WHEN user_rating <> 0 THEN user_rating END), 6) AS avg_rating FROM log WHERE event = 'user_interaction' GROUP BY strategy")
def ab_stats(t: Tables) -> DataFrame:
    return experiments.statistics(t.log)


@query("SELECT strategy, count(*) AS queries, round(sum(latency_ms) / count(*), 6) AS avg_latency_ms, round(sum(len(clicked_chunk_ids)) / CAST(count(*) AS DOUBLE), 6) AS click_through, round(avg(CASE WHEN user_rating <> 0 THEN user_rating END), 6) AS avg_rating FROM log WHERE event = 'user_interaction' GROUP BY strategy")
def stream_ab_stats(t: Tables) -> DataFrame:
    """The same through a stream: the log is appended as JSON lines, then read as a stream to its end."""
    from ..streaming.logs import ab_log, running_statistics

    place = own_folder(t.spark, "ab")
    experiments.append_log(t.log.select("event", "user_id", "strategy", "latency_ms", "clicked_chunk_ids", "user_rating"), f"{place}/log")
    name = f"ab_{uuid.uuid4().hex}"
    running_statistics(ab_log(t.spark, f"{place}/log"), name, f"{place}/state").awaitTermination()
    return t.spark.table(name)


@query("""WITH i AS (SELECT event_id AS experiment_id, ts FROM events WHERE event_id % 2 = 0),
  f AS (SELECT event_id AS experiment_id, ts + to_minutes(CAST(event_id % 5 * 20 AS INTEGER)) AS given, CAST(event_id % 6 AS INTEGER) AS user_rating FROM events WHERE event_id % 3 = 0)
  SELECT experiment_id, i.ts, f.user_rating FROM i LEFT JOIN f USING (experiment_id) WHERE true""".replace("WHERE true", "AND f.given <= i.ts + INTERVAL 1 HOUR").replace("USING (experiment_id) AND", "ON f.experiment_id = i.experiment_id AND").replace("SELECT experiment_id, i.ts", "SELECT i.experiment_id, i.ts"))
def stream_feedback(t: Tables) -> DataFrame:
    """Interactions and their feedback as two streams, some of it repeated, some too late, some missing; committed by batch."""
    place, e = own_folder(t.spark, "feedback"), t.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))
    i = e.filter("event_id % 2 = 0").select(F.col("event_id").alias("experiment_id"), "ts")
    given = F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 5 * 20).cast("int"))
    f = e.filter("event_id % 3 = 0").select(F.col("event_id").alias("experiment_id"), given.alias("ts"), F.array().cast("array<bigint>").alias("clicked_chunk_ids"), (F.col("event_id") % 6).cast("int").alias("user_rating"))
    end = e.agg((F.max("ts") + F.expr("INTERVAL 1000 DAYS")).alias("ts")).withColumn("experiment_id", F.lit(-1).cast("long"))  # closes what is open
    streams = {}
    for name, rows in (("interactions", i), ("feedback", f.unionByName(f.filter("experiment_id % 2 = 0")))):
        rows.coalesce(1).write.parquet(f"{place}/{name}")
        end.select(*[F.col(c) if c in end.columns else F.lit(None).cast(dict(rows.dtypes)[c]).alias(c) for c in rows.columns]).coalesce(1).write.mode("append").parquet(f"{place}/{name}")
        streams[name] = t.spark.readStream.schema(rows.schema).parquet(f"{place}/{name}")
    joined = feedback.with_late_feedback(streams["interactions"], streams["feedback"], late="400 days")
    feedback.start(joined, f"{place}/out", f"{place}/state").awaitTermination()
    return feedback.read_committed(t.spark, f"{place}/out", joined.schema).filter("experiment_id >= 0").select("experiment_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_rating")


@query("SELECT date_trunc('day', ts) AS window_start, strategy, count(*) AS queries, round(avg(latency_ms), 6) AS avg_latency_ms FROM log GROUP BY ALL")
def ab_windowed(t: Tables) -> DataFrame:
    from ..streaming.logs import windowed_statistics

    return windowed_statistics(t.log)


# --- evaluation -------------------------------------------------------------------------------


LAT = "l AS (SELECT strategy, CASE WHEN event_id % 7 <> 0 THEN latency_ms END AS ms FROM log)"


def _latencies(t: Tables) -> DataFrame:
    return t.log.select("strategy", F.when(F.col("event_id") % 7 != 0, F.col("latency_ms")).alias("ms"))


@query(f"WITH {LAT}, s AS (SELECT strategy, list_sort(list(ms) FILTER (ms IS NOT NULL)) AS v, round(avg(coalesce(ms, 0)), 6) AS mean, round(stddev_samp(ms), 6) AS stdev, min(ms) AS low, max(ms) AS high FROM l GROUP BY strategy) SELECT strategy, mean, stdev, low, high, v[len(v) // 2 + 1] AS median, v[CAST(floor(len(v) * 0.95::DOUBLE) AS BIGINT) + 1] AS p95, v[CAST(floor(len(v) * 0.99::DOUBLE) AS BIGINT) + 1] AS p99 FROM s")
def latency_stats_index(t: Tables) -> DataFrame:
    return ev.latency_by_index(_latencies(t), "strategy", "ms")


@query(f"WITH {LAT} SELECT strategy, round(avg(ms), 6) AS mean, round(quantile_cont(ms, 0.05), 6) AS p5, round(quantile_cont(ms, 0.5), 6) AS median, round(quantile_cont(ms, 0.95), 6) AS p95 FROM l GROUP BY strategy")
def latency_stats_linear(t: Tables) -> DataFrame:
    return ev.latency_linear(_latencies(t), "strategy", "ms")


@query("WITH a AS (SELECT strategy, CASE event_id % 3 WHEN 0 THEN 'b0' WHEN 1 THEN 'b1' ELSE 'b2' END AS bench, round(avg(latency_ms), 6) AS v FROM log GROUP BY ALL) SELECT strategy, max(CASE WHEN bench = 'b0' THEN v END) AS b0, max(CASE WHEN bench = 'b1' THEN v END) AS b1, max(CASE WHEN bench = 'b2' THEN v END) AS b2 FROM a GROUP BY strategy")
def pivot_latency(t: Tables) -> DataFrame:
    a = t.log.groupBy("strategy", F.concat(F.lit("b"), (F.col("event_id") % 3).cast("string")).alias("bench")).agg(F.round(F.avg("latency_ms"), 6).alias("v"))
    return ev.pivot_first(a, "strategy", "bench", "v", ["b0", "b1", "b2"])


RUNS = "r AS (SELECT 32 * (1 + event_id % 4) AS nlist, CAST(pow(2, event_id % 5) AS BIGINT) AS nprobe, latency_ms AS ms, (event_id % 11) / 10.0::DOUBLE AS recall FROM log), w AS (SELECT nlist, nprobe, count(*) AS queries, round(avg(ms), 6) AS avg_ms, round(median(ms), 6) AS median_ms, round(stddev_samp(ms), 6) AS std_ms, round(avg(recall), 6) AS avg_recall, round(median(recall), 6) AS median_recall, round(min(recall), 6) AS min_recall, round(max(recall), 6) AS max_recall FROM r GROUP BY ALL)"


def _runs(t: Tables) -> DataFrame:
    i = F.col("event_id")
    return t.log.select((32 * (1 + i % 4)).alias("nlist"), F.pow(F.lit(2), i % 5).cast("long").alias("nprobe"), F.col("latency_ms").alias("ms"), ((i % 11) / F.lit(10.0)).alias("recall"))


@query(f"WITH {RUNS} SELECT * FROM w")
def ivf_sweep(t: Tables) -> DataFrame:
    return ev.sweep(_runs(t))


@query(f"WITH {RUNS} SELECT * FROM w WHERE avg_recall >= 0.4 ORDER BY avg_ms, nlist, nprobe LIMIT 1")
def best_config(t: Tables) -> DataFrame:
    return ev.best_setting(ev.sweep(_runs(t)), 0.4)


@query("SELECT strategy, arg_min(latency_ms, event_id) AS first, arg_max(latency_ms, event_id) AS last, round(arg_max(latency_ms, event_id) - arg_min(latency_ms, event_id), 6) AS change FROM log GROUP BY strategy")
def trend(t: Tables) -> DataFrame:
    return ev.trend(t.log, "strategy", "event_id", "latency_ms")


@query("SELECT strategy, round(avg(latency_ms), 6) AS mean, round(stddev_pop(latency_ms), 6) AS std FROM log GROUP BY strategy")
def trial_stats(t: Tables) -> DataFrame:
    return ev.trial_stats(t.log, "strategy", "latency_ms")


# Two ways to rank each query's chunks: by all dimensions, and by the first half of them.
RANKED = "q AS (SELECT chunk_id AS query_id, embedding AS e FROM chunks WHERE chunk_id % 20 = 0), rk AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(embedding, e), 6) DESC, chunk_id) AS ra, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(embedding[1:32], e[1:32]), 6) DESC, chunk_id) AS rb FROM q, chunks), oa AS (SELECT query_id, chunk_id, ra AS rank FROM rk WHERE ra <= 10), ob AS (SELECT query_id, chunk_id, rb AS rank FROM rk WHERE rb <= 10), j AS (SELECT query_id, count(*) AS n, sum((oa.rank - ob.rank) * (oa.rank - ob.rank)) AS d FROM oa JOIN ob USING (query_id, chunk_id) GROUP BY query_id), k AS (SELECT DISTINCT query_id FROM oa)"


def _two_lists(t: Tables) -> tuple[DataFrame, DataFrame]:
    out = []
    for part in (64, 32):
        c = t.chunks.withColumn("embedding", F.slice("embedding", 1, part))
        q = c.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
        out.append(retrieval.batch_nearest(c, q, 10))
    return out[0], out[1]


@query(f"WITH {RANKED} SELECT query_id, round(coalesce(n, 0) / CAST(20 - coalesce(n, 0) AS DOUBLE), 6) AS jaccard, round(coalesce(n, 0) / 10.0::DOUBLE, 6) AS recall FROM k LEFT JOIN j USING (query_id)")
def jaccard_recall(t: Tables) -> DataFrame:
    a, b = _two_lists(t)
    o = ev.overlap(a, b)
    return o.select("query_id", F.round(ev.jaccard(F.col("n_a"), F.col("n_b"), F.col("n_both")), 6).alias("jaccard"), F.round(ev.recall(F.col("n_a"), F.col("n_both")), 6).alias("recall"))


@query(f"WITH {RANKED} SELECT query_id, round(CASE WHEN coalesce(n, 0) < 2 THEN 0 ELSE 1 - 6 * d / (CAST(n AS DOUBLE) * (n * n - 1)) END, 6) AS rank_correlation FROM k LEFT JOIN j USING (query_id)")
def rank_corr(t: Tables) -> DataFrame:
    a, b = _two_lists(t)
    return ev.rank_correlation(a, b)


@query("WITH g AS (SELECT doc_id % 7 AS query_id, doc_id AS chunk_id, quality, toxic FROM labels), n AS (SELECT query_id, count(CASE WHEN quality = 1 THEN 1 END) AS a, count(CASE WHEN toxic = 1 THEN 1 END) AS b, count(CASE WHEN quality = 1 AND toxic = 1 THEN 1 END) AS c FROM g WHERE quality = 1 OR toxic = 1 GROUP BY query_id), m AS (SELECT query_id, CASE WHEN a = 0 THEN 0 ELSE c / CAST(a AS DOUBLE) END AS p, CASE WHEN b = 0 THEN 0 ELSE c / CAST(b AS DOUBLE) END AS r FROM n) SELECT query_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM m")
def prf(t: Tables) -> DataFrame:
    g = t.raw("labels").select((F.col("doc_id") % 7).alias("query_id"), F.col("doc_id").alias("chunk_id"), "quality", "toxic")
    return ev.precision_recall(g.filter("quality = 1"), g.filter("toxic = 1"))


@query()
def pca_energy(t: Tables) -> DataFrame:
    e = ev.pca_energy(t.raw("embeddings"))
    rows = [(i + 1, round(x, 9), round(c, 9)) for i, (x, c) in enumerate(zip(e["explained"], e["cumulative"], strict=True))]
    return t.spark.createDataFrame(rows, "component int, share double, cumulative double")


@query()
def ablation_overlap(t: Tables) -> DataFrame:
    rows = ev.ablations(t.chunks, (0.8, 0.6, 0.4, 0.2), every=1)
    return t.spark.createDataFrame([(r["keep"], r["mean"], r["std"]) for r in rows], "keep double, mean double, std double")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm FROM embeddings")
def vector_norms(t: Tables) -> DataFrame:
    return t.raw("embeddings").select("vec_id", F.round(vec.norm(F.col("embedding")), 6).alias("norm"))
