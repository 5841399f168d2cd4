"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_out, release, runs, small_batches, text_column

# The base patterns. The upper-case and hex ones have their least length in them;
# a run too short has no longer match inside, so that is the same as dropping it afterwards.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORD = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KINDS = ("assign", "access", "hex", "entropy")

#: The window, and the entropy in bits that a window of a character class must reach.
WINDOW = 20
LEAST_BITS = {"hex": 3.0, "base36": 3.5, "base64": 3.9, "letters": 3.6}
#: Of letters alone a window must also change case like no words do: so many parts, a word with or without a capital being one.
LEAST_PARTS = 7
LETTERS = re.compile(r"[A-Za-z]{20,}")
#: Runs of one case within a candidate that are judged by their own class, whatever they are joined to.
RUNS = re.compile(r"[a-z0-9]{20,}|[A-Z0-9]{20,}"), re.compile(r"[0-9a-f]{20,}|[0-9A-F]{20,}")
#: What is not a secret however mixed it looks: UUIDs and tokens (what = / _ - part) that look like samples or
#: alphabets, cut out of their candidate so that the rest is judged, and pieces of nothing but words, a year and signs.
UUID = re.compile(r"(?<![A-Za-z0-9])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![A-Za-z0-9])")
SAMPLE = re.compile(r"EXAMPLE|example|sample|placeholder|dummy|xxxx|XXXX|123456789|abcdefghij|ABCDEFGHIJ")
TOKEN = re.compile(r"[A-Za-z0-9+]++")
#: Possessive throughout, and no two neighbours share a character: one way to match, time linear in the piece.
WORDS = re.compile(r"(?:/?+(?:[A-Za-z]++[/_=+-]++)++)?+[A-Za-z]*+[0-9]{0,4}+[/_=+-]*+|[0-9/_=+-]++")
_TERM = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 2)]


def char_class(candidate: str) -> str:
    return "hex" if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", candidate) else "base64"


def cuts(candidate: str) -> list[tuple[int, int]]:
    """What the allow-list takes out of a candidate, in order: UUIDs, and tokens that hold a sample's mark."""
    out = [m.span() for m in UUID.finditer(candidate)]
    if SAMPLE.search(candidate):
        out += [m.span() for m in TOKEN.finditer(candidate) if SAMPLE.search(candidate, *m.span())]
    return sorted(out)


def high_entropy(candidate: str, window: int = WINDOW, least: dict = LEAST_BITS) -> list[tuple[int, int]]:
    """Merged stretches of the windows that reach the least entropy of the candidate's class or of a run's own.

    What the allow-list matches is left out: alone, not with what is joined to it.
    """
    found, at = [], 0
    for start, end in [*cuts(candidate), (len(candidate), len(candidate))]:
        if start > at:
            found += [(a + at, b + at) for a, b in _piece(candidate[at:start], window, least)]
        at = max(at, end)
    return found


def part_begins(letters: str) -> list[int]:
    """1 for each letter that begins a part: a capital after a small letter, or a small letter after two capitals."""
    big = [c <= "Z" for c in letters]
    return [0, *(int(now and not last if now else last and i > 1 and big[i - 2]) for i, (last, now) in enumerate(zip(big, big[1:]), 1))]


def _piece(piece: str, window: int, least: dict) -> list[tuple[int, int]]:
    if len(piece) < window:
        return []
    found = []
    for m in LETTERS.finditer(piece):
        if not (m[0].islower() or m[0].isupper()):
            found += [(a + m.start(), b + m.start()) for a, b in _windows(m[0], window, least["letters"], part_begins(m[0]))]
    if not WORDS.fullmatch(piece):
        found += _windows(piece, window, least[char_class(piece)])
        for kind, pattern in zip(("base36", "hex"), RUNS, strict=True):
            for m in pattern.finditer(piece):
                if not WORDS.fullmatch(m[0]):
                    found += [(a + m.start(), b + m.start()) for a, b in _windows(m[0], window, least[kind])]
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def _windows(candidate: str, window: int, bits: float, begins: list[int] | None = None) -> list[tuple[int, int]]:
    """Merged stretches of the windows whose Shannon entropy reaches `bits` (and, given `begins`, that have LEAST_PARTS parts).

    Sum of c*log2(c) over the window's character counts changes at two counts a step, and so does the
    number of parts, those that begin behind the window's first letter and one.
    """
    need = (math.log2(window) - bits) * window + 1e-9  # entropy >= bits: the sum <= need
    found: list[tuple[int, int]] = []
    counts: dict[str, int] = {}
    total, parts = 0.0, 0
    term = _TERM if window == WINDOW else [0.0] + [c * math.log2(c) for c in range(1, window + 2)]
    for i, ch in enumerate(candidate):
        c = counts.get(ch, 0)
        total += term[c + 1] - term[c]
        counts[ch] = c + 1
        if i >= window:
            old = candidate[i - window]
            c = counts[old]
            total += term[c - 1] - term[c]
            counts[old] = c - 1
        if begins:
            parts += begins[i] - (begins[i - window + 1] if i >= window - 1 else 0)
        if i >= window - 1 and total <= need and (not begins or parts >= LEAST_PARTS - 1):
            start = i - window + 1
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((start, i + 1))
    return found


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind's place in KINDS, end) of the base spans and of all spans, each in order."""
    text = text or ""
    base: list[tuple[int, int, int]] = []
    if KEYWORD.search(text):
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    more, following, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        for a, b in () if m[0].islower() and m[0].isalpha() else high_entropy(m[0]):
            a, b = a + m.start(), b + m.start()
            while following < len(base) and base[following][0] <= a:  # both in order: one sweep
                reach = max(reach, base[following][2])
                following += 1
            if reach < b:
                more.append((a, 3, b))
    return base, sorted(base + more)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str | None, mask: str = "[REDACTED]") -> str | None:
    """The text with every span (overlapping ones as one) replaced by the mask; null stays null."""
    spans = scan(text)[1]
    if not spans:
        return text
    out, at = [], 0
    merged: list[list[int]] = []
    for s, _, e in spans:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[at:s], mask]
        at = e
    return "".join(out) + text[at:]


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find_secrets(docs: DataFrame) -> DataFrame:
    """A row per document: counts and digest of the base spans, and all spans as text.

    Null or empty text: no spans, the digest of the empty text. Null doc_id: kept. Repeated rows:
    a row each. Empty table: no rows. Other columns are not read.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        schema = pa.schema([("doc_id", pa.int64())] + [(n, pa.int64()) for n in ("n_assign", "n_access", "n_hex")] + [("base_sha256", pa.string()), ("spans", pa.string())])
        for part in runs(batches):
            found = [scan(t) for t in text_column(part).to_pylist()]
            yield arrow_out(
                schema,
                {
                    "doc_id": part.column("doc_id"),
                    **{f"n_{KINDS[k]}": [sum(s[1] == k for s in b) for b, _ in found] for k in range(3)},
                    "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found],
                    "spans": [joined(a) for _, a in found],
                },
            )

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(each, SCHEMA)


def redact_documents(docs: DataFrame) -> DataFrame:
    """`docs` with secrets masked in text, and n_chars (if there) counted anew where text changed.

    Every row and column stays, repeated rows too. Null and empty texts stay as they are, and so does
    a null n_chars of a text that does not change. Empty table: no rows. Very long texts: whole.
    """
    fields = docs.schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part in runs(batches):
            names = part.schema.names
            columns = {n: part.column(i) for i, n in enumerate(names)}
            old = text_column(part).to_pylist()
            new = [redact(t) for t in old]
            columns["text"] = pa.array(new, pa.string())
            if "n_chars" in names:
                columns["n_chars"] = pa.array([c if a == b else len(b) for a, b, c in zip(old, new, columns["n_chars"].to_pylist(), strict=True)], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(each, fields)
