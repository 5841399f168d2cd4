"""The engine as one object (2.M): search, filtered answers, facets, ingest, backfill."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.identifiers import citations
from .operators import answers, chunking, experiments, facets, filters, ner, retrieval, storage
from .operators import mention_vectors as vectors_of_mentions
from .plug import SYSTEM_PROMPT, USER_PROMPT, Embedder, EntityExtractor, ExtractiveGenerator, Generator, HashEmbedder, embed, prompt_context


class Engine:
    def __init__(self, spark: SparkSession, docs: DataFrame, chunks: DataFrame, mentions: DataFrame, embedder: Embedder | None = None, generator: Generator | None = None, extractor: EntityExtractor | None = None, mention_vectors: DataFrame | None = None):
        self.spark, self.docs, self.chunks, self.mentions = spark, docs, chunks, mentions
        self.embedder, self.generator = embedder or HashEmbedder(), generator or ExtractiveGenerator()
        self.extractor = extractor
        if mention_vectors is None:
            kind = dict(mentions.dtypes).get("mention_id", "bigint")
            mention_vectors = spark.createDataFrame([], f"mention_id {kind}, embedding array<float>, created_at timestamp")
        self.mention_vectors = mention_vectors

    def vector(self, question: str) -> list[float]:
        return [round(float(x), 6) for x in self.embedder.encode([question])[0]]

    def search(self, question: str, strategy: str = "ivfflat_only", k: int = 10) -> DataFrame:
        hits = retrieval.search(strategy, self.chunks, self.mentions, self.vector(question), question, k, model=self.embedder.name)
        return retrieval.contexts(hits, self.chunks, self.docs)

    def answer(self, question: str, k: int = 5, where: filters.Filters | None = None) -> dict:
        """3.2: at most 15 passages reach the driver; citations without a passage go, none at all means the first."""
        if not 1 <= k <= 15:
            raise ValueError("k is from 1 to 15")
        hits = retrieval.contexts(retrieval.filtered(self.chunks, self.docs, self.vector(question), where or filters.Filters(), k, self.embedder.name), self.chunks, self.docs)
        hits = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "chunk_id")))
        rows = [r.asDict() for r in hits.orderBy("rank").collect()]
        if not rows:
            return {"answer": None, "citations": [], "contexts": []}
        context = prompt_context(self.spark.createDataFrame([(r["rank"], r["doc_ref"], r["chunk_index"], r["text"]) for r in rows], "rank int, doc_ref string, chunk_index int, text string")).first().context
        text = self.generator.generate(SYSTEM_PROMPT, USER_PROMPT.format(context=context, question=question))
        cited = self.spark.createDataFrame([(text,)], "t string").select(citations(F.col("t")).alias("c")).first().c
        by = {(r["doc_ref"], r["chunk_index"]): r for r in rows}
        found = [by[(c.doc, c.idx)] for c in cited if (c.doc, c.idx) in by] or rows[:1]
        return {"answer": text, "citations": found, "contexts": rows}

    def answer_many(self, questions: DataFrame, k: int = 5, where: filters.Filters | None = None) -> DataFrame:
        """Any number of questions (query_id, question) in one plan: query_id, question, n_contexts, answer, citations."""
        asked = embed(questions, self.embedder, "question", "vector")
        return answers.answer_many(asked, self.chunks, self.docs, self.generator, k, where, self.embedder.name)

    def similar_mentions(self, text: str, label: str | None = None, k: int = 10) -> DataFrame:
        """By the vectors that ingest keeps up."""
        return retrieval.similar_mentions(self.mentions, self.mention_vectors, self.vector(text), label, k)

    def ab_answer(self, question: str, experiment: experiments.Experiment, user_id: str | None = None, session_id: str | None = None, method: str = "consistent", forced: str | None = None, k: int = 5, log_path: str | None = None) -> dict:
        """Assign a strategy, retrieve by it, answer, log; one call. Without a user the assignment is at random.

        A forced strategy must be registered and has the experiment_id forced_<name>. The first three
        passages are the citations. `log` is the event's row, appended to `log_path` if that is given.
        """
        if forced and forced not in experiment.names:
            raise ValueError(f"no strategy is called {forced}")
        if not experiment.names:
            raise ValueError("no strategy is registered")
        began = time.perf_counter()
        user = self.spark.createDataFrame([(user_id, session_id)], "user_id string, session_id string")
        given = experiment.assign(user, "random" if method == "consistent" and not user_id else method, seed=time.time_ns() % (1 << 31), forced=forced).first()
        rows = [r.asDict() for r in self.search(question, given.strategy, k).orderBy(F.desc("final_score"), "chunk_id").collect()]
        took = round((time.perf_counter() - began) * 1000, 3)
        event = [(given.experiment_id, user_id, session_id, given.strategy, question, len(rows), took, [], {"top_k": str(k)})]
        log = experiments.interactions(self.spark.createDataFrame(event, "experiment_id string, user_id string, session_id string, strategy string, query string, results_count int, latency_ms double, clicked_chunk_ids array<long>, metadata map<string,string>").withColumn("timestamp", F.current_timestamp().cast("string")))
        if log_path:
            experiments.append_log(log, log_path)
        answer = f"{len(rows)} passages were found for: {question}" if rows else None
        return {"answer": answer, "citations": rows[:3], "contexts": rows, "experiment_id": given.experiment_id, "strategy": given.strategy, "latency_ms": took, "log": log}

    def facets(self) -> dict:
        return facets.facets(self.docs)

    def ingest(self, docs: DataFrame, most: int = 800, overlap: int = 80) -> Engine:
        """3.3: new documents (ext_id, text, ...) to documents, chunks with embeddings, mentions; as set operations."""
        merged = storage.upsert_documents(self.docs, docs.select(*[c for c in docs.columns if c in self.docs.columns and c != "doc_id"]))
        named = docs.select("ext_id", "text", "source_id").join(merged.select("ext_id", "doc_id"), "ext_id")
        made = chunking.chunk_documents(named, most, overlap, source_id="source_id")
        made = embed(made, self.embedder, "full_text").withColumn("embedding_model", F.lit(self.embedder.name)).withColumn("chunk_id", F.xxhash64("doc_id", "chunk_index"))
        found = ner.dedup(ner.extract_mentions(made.withColumn("text", F.col("full_text")), extractor=self.extractor)).withColumn("mention_id", F.xxhash64("doc_id", "section_name", "label", F.lower("mention_text")))
        keep = [c for c in self.chunks.columns if c in made.columns]
        chunks = storage.upsert_chunks(self.chunks, made.select(*keep))
        mentions = storage.append_mentions(self.mentions, found.select(*[c for c in self.mentions.columns if c in found.columns]))
        vectors = vectors_of_mentions.kept_up(self.mention_vectors, mentions, self.embedder)
        return Engine(self.spark, merged, chunks, mentions, self.embedder, self.generator, self.extractor, vectors)

    def backfill_mentions(self, vocabulary: dict[str, str] | None = None) -> tuple[DataFrame, dict]:
        """Mentions of the documents that have none, and the totals."""
        todo = storage.docs_without_mentions(self.chunks, self.mentions)
        chunks = self.chunks.join(todo, "doc_id", "left_semi").withColumn("section_name", F.coalesce("section_name", F.lit("Document")))
        found = ner.dedup(ner.extract_mentions(chunks, vocabulary, self.extractor))
        totals = found.agg(F.count_distinct("doc_id").alias("docs"), F.count_distinct("doc_id", "section_name").alias("sections"), F.count(F.lit(1)).alias("mentions")).first()
        return found, totals.asDict()
