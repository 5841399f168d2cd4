"""The engine's tables derived from the driver's, in Spark and (the same) in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import chunk_documents
from ..operators import mention_vectors
from ..operators.ivf import IvfIndex, suggested_lists
from ..operators.names import NameIndex
from ..operators.postings import TextIndex
from ..plug import HashEmbedder
from ..session import listing, own_folder, small_batches

#: Patterns that stand for the four labels in invented prose; RE2 and Java read them alike.
LABEL_PATTERNS = (("device", "[a-z]{2,}ment"), ("disease", "[a-z]{2,}heit"), ("drug", "[a-z]{3,}tion"), ("statistical_significance", "[0-9]+"))
MODEL = "hash-64"


#: What this application has stored, by application, folder and name: the files that it was made of, and how to read it.
_STORED: dict[tuple[str, str, str], tuple[tuple, object]] = {}


def ingested(t: "Tables", name: str, sources: tuple[str, ...], make: Callable[[str], Callable[[], object]]):
    """What `make(folder)` has stored and reads, made again when a source's files are others than before.

    Queries then read tables, as they do in an engine that is in use; the files go when the driver ends.
    """
    at, files = (t.spark.sparkContext.applicationId, t.dir, name), tuple(listing(t.spark, f"{t.dir}/{s}.parquet") for s in sources)
    if at not in _STORED or _STORED[at][0] != files:
        _STORED[at] = files, make(own_folder(t.spark, f"tables-{name}"))
    return _STORED[at][1]()


#: Rows of the table that a stored one follows, for a file: at most, and at least where there are cores for more files.
FILE_ROWS, FEW_ROWS = 20_000, 500


def in_order(df: DataFrame, key: str, source: DataFrame, number: str, follows: str) -> DataFrame:
    """`df` in order of `key`, dealt by its column `follows` at quantiles of the numbers that it comes from.

    A range shuffle takes its bounds from `df`, which is made twice for it; these come from one column of the source.
    """
    rows, cores = source.count(), df.sparkSession.sparkContext.defaultParallelism
    n = max(1, -(-rows // FILE_ROWS), min(cores, rows // FEW_ROWS))
    bounds = sorted(set(source.approxQuantile(number, [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else []
    part = F.size(F.filter(F.lit([int(b) for b in bounds]), lambda b: b <= F.col(follows))) if bounds else F.lit(0)
    return df.repartitionById(n, part.cast("int")).sortWithinPartitions(key)


#: Numbers of a range that in_use() looks at together, and the most such ranges that are broadcast.
RANGE, MOST_RANGES = 1024, 100_000


def in_use(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """`df` without (most of) the rows that a join with `keys` on a whole number drops, so that these are not shuffled for it.

    Ranges of RANGE numbers that hold a key are counted, and broadcast if they are at most MOST_RANGES;
    else all rows go on.
    """
    place = F.floor(F.col(key) / RANGE)
    ranges = keys.select(place.alias("_range")).distinct()
    if ranges.limit(MOST_RANGES + 1).count() > MOST_RANGES:
        return df
    return df.join(F.broadcast(ranges), place == F.col("_range"), "left_semi")


def stored(key: str, *sources: str, follows: tuple[str, str, str] | None = None):
    """The table is ingested once an application and folder: written in order of `key`, so that a few keys read a few row groups.

    `follows`: a source, its number, and the column here that has it, if the order by `key` is that by this number.
    """

    def of(make: Callable[["Tables"], DataFrame]):
        @wraps(make)
        def table(self: "Tables") -> DataFrame:
            def write(folder: str) -> Callable[[], DataFrame]:
                df = make(self)
                dealt = in_order(df, key, self.raw(follows[0]), *follows[1:]) if follows else df.repartitionByRange(key).sortWithinPartitions(key)
                dealt.write.mode("overwrite").parquet(folder)
                return lambda: self.spark.read.schema(df.schema).parquet(folder)

            return ingested(self, make.__name__, sources, write)

        return cached_property(table)  # named as `make` is

    return of


class Tables:
    """What a query reads: the driver's tables, and the engine's, made of them once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        small_batches(spark)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @stored("doc_id", "documents", follows=("documents", "doc_id", "doc_id"))
    def docs(self) -> DataFrame:
        """What is known of the documents besides their texts, which few queries read: those are not dealt and written once more."""
        return self.docs_with_text.drop("text")

    @property
    def docs_with_text(self) -> DataFrame:
        i = F.col("doc_id")
        return self.raw("documents").select(
            "doc_id",
            F.concat(F.when(i % 3 == 0, "pmcid://pmc").when(i % 3 == 1, "arxiv://2401.").otherwise("scholar://s"), i.cast("string")).alias("ext_id"),
            F.concat(F.lit("Title "), i.cast("string")).alias("title"),
            F.when(i % 3 == 0, "PubMed Central").when(i % 3 == 1, "arXiv").otherwise("Google Scholar").alias("source"),
            F.concat(F.lit("x"), i.cast("string")).alias("source_id"),
            F.when(i % 7 != 0, F.concat(F.lit("Institute "), F.upper("lang"), (i % 9).cast("string"))).alias("institute"),
            F.array(F.concat(F.lit("Smith "), (i % 11).cast("string")), F.concat(F.lit("Chen "), (i % 5).cast("string"))).alias("author"),
            F.when(i % 13 != 0, F.make_date((F.lit(2000) + i % 25).cast("int"), F.lit(1), F.lit(1))).alias("year"),
            "text",
        )

    @stored("chunk_id", "documents", "embeddings", follows=("embeddings", "vec_id", "chunk_id"))
    def chunks(self) -> DataFrame:
        v = self.raw("embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("doc_id"), "embedding", F.col("label").cast("long").alias("label"))
        d = in_use(self.raw("documents").select("doc_id", "text"), v, "doc_id")
        i = F.col("doc_id")
        return v.join(d, "doc_id").select("chunk_id", "doc_id", (i % 4).cast("int").alias("chunk_index"), "text", "embedding", F.when(i % 10 == 9, F.lit("other")).otherwise(F.lit(MODEL)).alias("embedding_model"), F.when(i % 17 != 0, F.concat(F.lit("S"), (i % 3).cast("string"))).alias("section_name"), "label")

    @stored("chunk_id", "documents", follows=("documents", "doc_id", "doc_id"))
    def whole_chunks(self) -> DataFrame:
        """The chunker's chunks of whole documents, with their full text; chunk_id is the document's and the index."""
        c = chunk_documents(self.raw("documents").select("doc_id", "text"))
        return c.select((F.col("doc_id") * 1_000_000 + F.col("chunk_index")).alias("chunk_id"), "doc_id", "chunk_index", F.col("full_text").alias("text"), "section_name")

    @stored("doc_id", "documents", follows=("documents", "doc_id", "doc_id"))
    def mentions(self) -> DataFrame:
        d = self.raw("documents").select("doc_id", "text")
        # Places are found before the mentions part: the text goes with none of them.
        named = lambda n: lambda m: F.struct(F.lit(n).alias("label"), m.alias("mention_text"), F.instr("text", m).cast("long").alias("start_char"))
        labels = F.array(*[F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(p), 0)), named(n)) for n, p in LABEL_PATTERNS])
        m = d.select("doc_id", F.explode(F.flatten(labels)).alias("m"))
        i = F.col("doc_id")
        named_by = F.md5(F.concat_ws(":", i.cast("string"), "m.label", "m.mention_text").cast("binary"))
        return m.select("doc_id", "m.mention_text", "m.label", named_by.alias("mention_id"), "m.start_char", F.date_add(F.lit("2020-01-01").cast("date"), (i % 1000).cast("int")).alias("created_at"), F.when(i % 17 != 0, F.concat(F.lit("S"), (i % 3).cast("string"))).alias("section_name"))

    @stored("doc_id", "documents", follows=("documents", "doc_id", "doc_id"))
    def ids(self) -> DataFrame:
        """document_ids: journal DOIs, arXiv DOIs and PMC ids of some documents."""
        i, s = F.col("doc_id"), F.col("doc_id").cast("string")
        kinds = F.array(
            F.when(i % 4 == 0, F.struct(F.lit("doi").alias("id_type"), F.concat(F.lit("10.1000/J"), s).alias("id_value"))),
            F.when(i % 6 == 1, F.struct(F.lit("doi").alias("id_type"), F.concat(F.lit("10.48550/arXiv."), s).alias("id_value"))),
            F.when(i % 3 == 0, F.struct(F.lit("pmcid").alias("id_type"), F.concat(F.lit("PMC"), s).alias("id_value"))),
        )
        return self.raw("documents").select("doc_id", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k")).select("doc_id", "k.id_type", "k.id_value")

    @stored("event_id", "events", follows=("events", "event_id", "event_id"))
    def log(self) -> DataFrame:
        """The A/B log of the events: strategy by user, latency by value, clicks, ratings."""
        i = F.col("event_id")
        return self.raw("events").select(
            F.when(i % 20 == 0, "strategy_assignment").otherwise("user_interaction").alias("event"),
            "event_id",
            "ts",
            F.col("user_id").cast("string").alias("user_id"),
            F.element_at(F.lit(["s1", "s2", "s3", "s4"]), (F.col("user_id") % 4 + 1).cast("int")).alias("strategy"),
            F.round("value", 3).alias("latency_ms"),
            F.when(F.col("event_type") == "click", F.array(i, i + 1)).otherwise(F.array().cast("array<bigint>")).alias("clicked_chunk_ids"),
            F.when(i % 5 == 0, F.lit(None).cast("int")).otherwise((i % 6).cast("int")).alias("user_rating"),
        )

    @cached_property
    def word_index(self) -> TextIndex:
        """Full text of `chunks` by plain words."""
        return self._text_index("words", self.chunks, ("doc_id", "section_name", "embedding_model"), "documents", "embeddings")

    @cached_property
    def english_index(self) -> TextIndex:
        """Full text of `whole_chunks` by English stems."""
        return self._text_index("english", self.whole_chunks, ("doc_id", "section_name"), "documents")

    @cached_property
    def names(self) -> NameIndex:
        """The authors and institutes of `docs`."""

        def write(folder: str) -> Callable[[], NameIndex]:
            NameIndex.build(self.docs, folder)
            return lambda: NameIndex(self.spark, folder)

        return ingested(self, "names", ("documents",), write)

    @stored("mention_id", "documents")
    def mention_vectors(self) -> DataFrame:
        """The vectors of `mentions`."""
        return mention_vectors.mention_vectors(self.mentions, HashEmbedder(64), None)

    def _text_index(self, analyzer: str, chunks: DataFrame, carry: tuple[str, ...], *sources: str) -> TextIndex:
        def write(folder: str) -> Callable[[], TextIndex]:
            TextIndex.build(chunks, folder, analyzer, carry)
            return lambda: TextIndex.open(self.spark, folder)

        return ingested(self, f"{analyzer}_index", sources, write)

    @cached_property
    def lists(self) -> IvfIndex:
        """The inverted lists of `chunks` of the model."""

        def write(folder: str) -> Callable[[], IvfIndex]:
            IvfIndex.build(self.chunks, folder, suggested_lists(self.chunks.count()), MODEL)
            return lambda: IvfIndex.open(self.spark, folder)

        return ingested(self, "lists", ("documents", "embeddings"), write)

    def vector(self, vec_id: int = 0) -> list[float]:
        """A query vector, by its id: one row."""
        return [float(x) for x in self.raw("embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first().embedding]


def _mention_sql() -> str:
    parts = [f"SELECT doc_id, text, unnest(list_distinct(regexp_extract_all(text, '{p}'))) AS mention_text, '{n}' AS label FROM p" for n, p in LABEL_PATTERNS]
    return " UNION ALL ".join(parts)


#: The same tables as the classes' properties, as common table expressions.
SQL = f"""
p AS (SELECT doc_id, text FROM documents),
docs AS (SELECT doc_id,
  CASE doc_id % 3 WHEN 0 THEN 'pmcid://pmc' WHEN 1 THEN 'arxiv://2401.' ELSE 'scholar://s' END || doc_id AS ext_id,
  'Title ' || doc_id AS title,
  CASE doc_id % 3 WHEN 0 THEN 'PubMed Central' WHEN 1 THEN 'arXiv' ELSE 'Google Scholar' END AS source,
  'x' || doc_id AS source_id,
  CASE WHEN doc_id % 7 <> 0 THEN 'Institute ' || upper(lang) || (doc_id % 9) END AS institute,
  ['Smith ' || (doc_id % 11), 'Chen ' || (doc_id % 5)] AS author,
  CASE WHEN doc_id % 13 <> 0 THEN make_date(2000 + doc_id % 25, 1, 1) END AS year,
  text FROM documents),
chunks AS (SELECT vec_id AS chunk_id, doc_id, CAST(doc_id % 4 AS INTEGER) AS chunk_index, text, CAST(embedding AS DOUBLE[]) AS embedding,
  CASE WHEN doc_id % 10 = 9 THEN 'other' ELSE '{MODEL}' END AS embedding_model,
  CASE WHEN doc_id % 17 <> 0 THEN 'S' || (doc_id % 3) END AS section_name, CAST(label AS BIGINT) AS label
  FROM embeddings JOIN p ON vec_id = doc_id),
mentions AS (SELECT doc_id, mention_text, label, md5(doc_id || ':' || label || ':' || mention_text) AS mention_id, CAST(instr(text, mention_text) AS BIGINT) AS start_char, DATE '2020-01-01' + CAST(doc_id % 1000 AS INTEGER) AS created_at, CASE WHEN doc_id % 17 <> 0 THEN 'S' || (doc_id % 3) END AS section_name FROM ({_mention_sql()})),
ids AS (
  SELECT doc_id, 'doi' AS id_type, '10.1000/J' || doc_id AS id_value FROM p WHERE doc_id % 4 = 0
  UNION ALL SELECT doc_id, 'doi', '10.48550/arXiv.' || doc_id FROM p WHERE doc_id % 6 = 1
  UNION ALL SELECT doc_id, 'pmcid', 'PMC' || doc_id FROM p WHERE doc_id % 3 = 0),
log AS (SELECT CASE WHEN event_id % 20 = 0 THEN 'strategy_assignment' ELSE 'user_interaction' END AS event, event_id, ts, CAST(user_id AS VARCHAR) AS user_id,
  's' || (user_id % 4 + 1) AS strategy, round(value, 3) AS latency_ms, CASE WHEN event_type = 'click' THEN [event_id, event_id + 1] ELSE [] END AS clicked_chunk_ids,
  CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 6 AS INTEGER) END AS user_rating FROM events)
"""
