"""Entity mentions: statistics, devices and a pluggable vocabulary (I38-I42, C14, F5, H3, A.4)."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from ..plug import EntityExtractor

# What states a significance, what names a device, and the labels of models' entities.
STATISTICS_PATTERNS = (
    r"\bp\s*[<>=≤≥]\s*0\.\d+\b",
    r"\bp-value\s*[<>=≤≥]\s*0\.\d+\b",
    r"\bp\s*=\s*\.\d+\b",
    r"\b\d+%\s*(?:confidence|CI)\s*interval",
    r"\bCI\s*[:\s]*\[?[\d\.\-\s,]+\]?",
    r"\b95%\s*CI\b",
    r"\bstatistically\s+significant\b",
    r"\bsignificant\s+(?:difference|effect|improvement|reduction|increase)\b",
    r"\bp\s*[<]\s*0\.05\b",
    r"\bp\s*[<]\s*0\.01\b",
    r"\bp\s*[<]\s*0\.001\b",
)
DEVICE_PATTERNS = (
    r"\b(?:catheter|stent|pacemaker|defibrillator|implant|prosthesis|ventilator)s?\b",
    r"\b(?:MRI|CT|PET|ultrasound|X-ray|scanner|monitor)\b",
    r"\b(?:surgical|medical)\s+(?:device|instrument|equipment)\b",
    r"\b(?:insulin\s+pump|hearing\s+aid|wheelchair)\b",
)
MODEL_LABELS = {
    "DISEASE": "disease",
    "DISORDER": "disease",
    "SYMPTOM": "disease",
    "SYNDROME": "disease",
    "CHEMICAL": "drug",
    "DRUG": "drug",
    "MEDICATION": "drug",
    "PHARMACEUTICAL": "drug",
}
# All begin at a word's edge with one of a few signs: most places of a text are left after one look.
STATISTICS = re.compile(rf"\b(?=[psc\d])(?:{'|'.join(STATISTICS_PATTERNS)})", re.IGNORECASE)
DEVICES = re.compile(rf"\b(?=[cdhimpsuvwx])(?:{'|'.join(DEVICE_PATTERNS)})", re.IGNORECASE)
CONFIDENCE = {"statistical_significance": 0.9, "device": 0.85, "model": 0.8}
SECTION = re.compile(r"\A\[[^\]\n]*\]\n")
CUT = re.compile(r"(?<=[.?!])\s+(?=[A-Z0-9(])")


def strip_prefix(text: str) -> tuple[str, int]:
    """C14: without what precedes the first blank line, then without `[Section]`; and how much went."""
    cut = text.find("\n\n")
    gone = cut + 2 if cut >= 0 else 0
    m = SECTION.match(text[gone:])
    gone += m.end() if m else 0
    return text[gone:], gone


class Sentences:
    """A text's sentences, cut once; the context of a span is the sentence that it lies in, or what is within 100 characters."""

    def __init__(self, text: str):
        cuts = list(CUT.finditer(text))
        self.text, self.begin, self.end = text, [0, *(m.end() for m in cuts)], [*(m.start() for m in cuts), len(text)]

    def context(self, start: int, end: int) -> str:
        i = bisect_right(self.begin, start) - 1
        if start < self.end[i] and end <= self.end[i]:
            return self.text[self.begin[i] : self.end[i]].strip()
        return self.text[max(0, start - 100) : end + 100]


#: Terms of a vocabulary that is broadcast, and their characters, at most.
MOST_TERMS, MOST_CHARACTERS = 1_000_000, 32_000_000


def lowered(text: str) -> str:
    """In lower case, letter by letter, so that places stay: the few letters that would become several stay as they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


WORD = re.compile(r"\w+")


class Vocabulary:
    """The offline stand-in for a model: terms with their labels (a model's, or ours): words looked up, others found by one automaton in one pass.

    A term is found where a word begins or ends at both of its ends, whatever its case. Of terms that
    overlap the one that begins first is taken, of those the longest; then what begins after it.
    Blank terms are none. The automaton is built once and sent to each worker once: its size grows
    with the vocabulary, which is checked.
    """

    def __init__(self, terms: dict[str, str]):
        import ahocorasick

        self.labels = {lowered(t): MODEL_LABELS.get(v, v) for t, v in terms.items() if t.strip()}
        if len(self.labels) > MOST_TERMS or sum(map(len, self.labels)) > MOST_CHARACTERS:
            raise ValueError(f"a vocabulary has at most {MOST_TERMS} terms of {MOST_CHARACTERS} characters; extract by parts of it")
        # At word edges a term of word signs alone is a whole word: those are looked up, so that the automaton does not stop at each "a" in a word.
        phrases = [t for t in self.labels if not WORD.fullmatch(t)]
        self.automaton = ahocorasick.Automaton() if phrases else None
        for t in phrases:
            self.automaton.add_word(t, len(t))
        if phrases:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, label) in order."""
        if not self.labels:
            return []
        low, edge = lowered(text), bytearray(len(text) + 1)
        found: dict[int, int] = {}
        for m in WORD.finditer(text):
            start, end = m.span()
            edge[start] = edge[end] = 1
            if low[start:end] in self.labels:
                found[start] = end
        for last, size in self.automaton.iter(low) if self.automaton else ():
            start, end = last + 1 - size, last + 1
            if edge[end] and edge[start] and end > found.get(start, 0):
                found[start] = end
        out, at = [], 0
        for start in sorted(found):
            if start >= at:
                at = found[start]
                out.append((start, at, self.labels[low[start:at]]))
        return out


#: Mentions, and characters of their contexts, that a task holds before it hands them on.
HELD_MENTIONS, HELD_CHARACTERS = 10_000, 2_000_000


def entities(text: str | None, vocabulary: Vocabulary | dict[str, str] | None = None, extractor: EntityExtractor | None = None) -> list[tuple[str, str, int, int, str, float]]:
    """A.4, H3: (text, label, start, end, context, confidence): extractor, vocabulary, then statistics, then devices; offsets are in `text`."""
    return list(each_entity(text, vocabulary, extractor))


def each_entity(text: str | None, vocabulary: Vocabulary | dict[str, str] | None = None, extractor: EntityExtractor | None = None, contexts: bool = True) -> Iterator[tuple[str, str, int, int, str | None, float]]:
    """entities() one by one, so that contexts (of a text without stops: all of it, each time) are not held together; null ones without `contexts`."""
    body, gone = strip_prefix(text or "")
    sentences = Sentences(body) if contexts else None
    found = [(shown, MODEL_LABELS.get(kind, kind), a, b, CONFIDENCE["model"]) for shown, kind, a, b in (extractor.extract(body) if extractor else [])]
    if vocabulary:
        known = Vocabulary(vocabulary) if isinstance(vocabulary, dict) else vocabulary
        found += [(body[a:b].strip(), label, a, b, CONFIDENCE["model"]) for a, b, label in known.find(body)]
    for pattern, label in ((STATISTICS, "statistical_significance"), (DEVICES, "device")):
        found += [(m[0].strip(), label, m.start(), m.end(), CONFIDENCE[label]) for m in pattern.finditer(body)]
    for shown, label, a, b, sure in found:
        yield shown, label, a + gone, b + gone, sentences.context(a, b) if sentences else None, sure


def extract_mentions(chunks: DataFrame, vocabulary: Vocabulary | dict[str, str] | None = None, extractor: EntityExtractor | None = None, contexts: bool = True) -> DataFrame:
    """doc_id, section_name, chunk_index and each mention's columns; each chunk by itself. The vocabulary is checked (Vocabulary) and broadcast.

    Mentions go on as they are found: a task holds HELD_MENTIONS of them and HELD_CHARACTERS of their
    contexts, and one context more. Whoever does not need contexts has null ones without `contexts`.
    """
    known = Vocabulary(vocabulary) if isinstance(vocabulary, dict) else vocabulary
    shared = chunks.sparkSession.sparkContext.broadcast(known)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "section_name", "chunk_index", "ordinal", "mention_text", "label", "start_char", "end_char", "context", "label_confidence"]
        for b in batches:
            rows, characters = [], 0
            for doc, section, index, text in zip(b.doc_id, b.section_name, b.chunk_index, b.text, strict=True):
                for i, e in enumerate(each_entity(text, shared.value, extractor, contexts)):
                    rows.append((doc, section, index, i, *e))
                    characters += len(e[4] or "")
                    if len(rows) >= HELD_MENTIONS or characters >= HELD_CHARACTERS:
                        yield pd.DataFrame(rows, columns=names)
                        rows, characters = [], 0
            yield pd.DataFrame(rows, columns=names)

    schema = "doc_id long, section_name string, chunk_index int, ordinal int, mention_text string, label string, start_char int, end_char int, context string, label_confidence double"
    return chunks.select("doc_id", "section_name", "chunk_index", "text").mapInPandas(each, schema)


def dedup(mentions: DataFrame, *order: str) -> DataFrame:
    """the first of each (text, label, section) of a document, ignoring case and outer spaces; a null section is an empty one."""
    key = ["doc_id", F.lower(F.trim("mention_text")), "label", F.coalesce("section_name", F.lit(""))]
    w = Window.partitionBy(*key).orderBy(*(order or ("chunk_index", "ordinal")))
    return mentions.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def label_counts(mentions: DataFrame) -> DataFrame:
    """Mentions a document and label."""
    return mentions.groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("mentions"))


def statistics(mentions: DataFrame) -> DataFrame:
    """Mentions by label, with the row of all and the share of each."""
    g = mentions.rollup("label").agg(F.count(F.lit(1)).alias("mentions"), F.grouping("label").alias("_all"))
    total = F.max(F.when(F.col("_all") == 1, F.col("mentions"))).over(Window.partitionBy())
    return g.select(F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col("label")).alias("label"), "mentions", F.round(100 * F.col("mentions") / total, 4).alias("percent"))
