"""Words of plain letters through a byte-pair engine that knows no ends of words: an end is a byte that no letter uses."""

from __future__ import annotations

import json
import re

# The form of the vocabularies that this is for.
ENDING = "</w>"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Lower-case letters of Latin-1 (one run, which is one piece before the merges), then signs (another one).
WORD = re.compile("([a-zß-öø-ÿ]+)([.,;:!?]*)")
#: The bytes of these letters in UTF-8; a word never ends in C3.
LAST = [*range(0x61, 0x7B), *range(0x80, 0xC0)]
INNER = {*LAST, 0xC3}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBpe:
    """Ids of such words. Merges are those of the vocabulary, by rank, over bytes; a word's last byte is another byte.

    Only for vocabularies in which ids follow the order of the merges and ends of words are marked;
    `of` gives None for others.
    """

    def __init__(self, vocab: dict[str, int]):
        import tiktoken

        self.table = bytearray(range(256))
        for b, other in zip(LAST, (b for b in range(256) if b not in INNER)):
            self.table[b] = other
        letters, ranks = byte_letters(), {}
        for token, i in vocab.items():
            ended = token.endswith(ENDING)
            spelt = bytes(letters.get(c, 0) for c in token.removesuffix(ENDING))
            if spelt and INNER.issuperset(spelt) and (not ended or spelt[-1] in LAST):
                ranks[self.ended(spelt) if ended else spelt] = i
        for b in range(256):  # the engine asks for all bytes
            ranks.setdefault(bytes([b]), len(vocab) + b)
        self.engine = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, path: str) -> WordBpe | None:
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model, split = said["model"], (said.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        merges = [m if isinstance(m, str) else " ".join(m) for m in model.get("merges", [])]
        made = [model["vocab"].get(m.replace(" ", ""), -1) for m in merges]
        fits = model.get("end_of_word_suffix") == ENDING and not model.get("dropout") and [n["type"] for n in (said.get("normalizer") or {}).get("normalizers", [])] == NORMALIZERS
        fits = fits and split.get("pattern") == {"Regex": SPLIT} and made == sorted(made) and min(made, default=-1) >= 0
        return cls(model["vocab"]) if fits else None

    def ended(self, spelt: bytes) -> bytes:
        return spelt[:-1] + bytes([self.table[spelt[-1]]])

    def tokenized(self, words: list[str], signs) -> list[list[int] | None]:
        """Each word's ids, None for words of other signs; `signs(text)` gives the ids of a run of signs. Equal letters are merged once."""
        known: dict[str, list[int]] = {}
        marks: dict[str, list[int]] = {"": []}
        fits, piece, last = WORD.fullmatch, self.engine._core_bpe.encode_single_piece, [bytes([b]) for b in self.table]
        out: list[list[int] | None] = []
        for w in words:
            m = fits(w) or fits(w.lower())
            if m is None:
                out.append(None)
                continue
            letters, mark = m.groups()
            ids = known.get(letters)
            if ids is None:
                spelt = letters.encode()
                ids = known[letters] = piece(spelt[:-1] + last[spelt[-1]])
            if mark:
                if mark not in marks:
                    marks[mark] = signs(mark)
                ids = ids + marks[mark]
            out.append(ids)
        return out
