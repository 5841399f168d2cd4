"""Declared schemas of the engine's tables, as DDL (nothing is inferred)."""

DOCUMENTS = "doc_id long, ext_id string, title string, source_uri string, author array<string>, year date, journal string, institute string, source string, source_id string, tags array<string>, captured_at timestamp, doi string"
CHUNKS = "chunk_id long, doc_id long, chunk_index int, text string, metadata string, embedding array<float>, embedding_model string, content_hash string, created_at timestamp, section_name string"
MENTIONS = "mention_id long, doc_id long, mention_text string, label string, start_char int, end_char int, context string, label_confidence double, section_name string, created_at timestamp"
MENTION_EMBEDDINGS = "mention_id long, embedding array<float>, created_at timestamp"
DOCUMENT_IDS = "doc_id long, id_type string, id_value string"
AB_EVENTS = "event string, experiment_id string, user_id string, session_id string, strategy string, query string, results_count int, latency_ms double, clicked_chunk_ids array<long>, user_rating int, user_feedback string, timestamp string, metadata map<string,string>"
BENCHMARK_RUN = "timestamp string, config struct<num_queries:int, top_k:int, embedding_model:string, queries:array<string>>, strategy_metrics map<string, struct<avg_latency_ms:double, median_latency_ms:double, p95_latency_ms:double, p99_latency_ms:double, std_latency_ms:double, min_latency_ms:double, max_latency_ms:double>>"

#: The labels a mention may have, and the kinds an identifier may have.
MENTION_LABELS = ("disease", "statistical_significance", "device", "drug")
ID_TYPES = ("pmid", "pmcid", "doi", "arxiv", "arxiv-doi", "biorxiv", "medrxiv")

TABLES = {"documents": DOCUMENTS, "chunks": CHUNKS, "mentions": MENTIONS, "mention_embeddings": MENTION_EMBEDDINGS, "document_ids": DOCUMENT_IDS}


def create(spark, database: str = "ragspark", partitions: dict[str, list[str]] | None = None) -> None:
    """The tables, if they are not there; chunks by model, so that a search reads one model's files."""
    by = {"chunks": ["embedding_model"]} | (partitions or {})
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in TABLES.items():
        part = f" PARTITIONED BY ({', '.join(by[name])})" if name in by else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns.replace(' long', ' bigint')}) USING parquet{part}")


def valid_mentions(df):
    """The rows whose label is one (the table's CHECK)."""
    return df.filter(df["label"].isin(*MENTION_LABELS))


def valid_ids(df):
    return df.filter(df["id_type"].isin(*ID_TYPES))
