"""English text as lexemes with positions (I4): tokens of many kinds, stop words, the Snowball English stemmer.

Kinds follow the common default parser of full-text search: words and hyphenated words (whole, then
part by part) are stemmed; numbers, versions, mixed words, addresses, hosts and paths are kept in
lower case; tags, entities and a link's protocol are nothing. Stemming follows the published
description of the Snowball English algorithm, rule by rule.
"""

from __future__ import annotations

import re
from functools import lru_cache

# English words that are no lexemes.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)

# Fixed values of the stemmer: whole words, prefixes with their own first region, and the suffixes of steps 2 to 4.
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
WHOLE_AFTER_1A = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
PREFIXES = ("gener", "commun", "arsen")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_AFTER = "cdeghkmnrt"
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

VOWEL = "aeiouy"
_AFTER_VOWEL_PAIR = re.compile(f"[{VOWEL}][^{VOWEL}]")
_SHORT_END = re.compile(f"(^[{VOWEL}][^{VOWEL}]|[^{VOWEL}][{VOWEL}][^{VOWEL}wxY])$")


def _region(word: str, start: int) -> int:
    """Where the region after the first consonant that follows a vowel, from `start` on, begins."""
    m = _AFTER_VOWEL_PAIR.search(word, start)
    return m.end() if m else len(word)


def _ending(word: str, endings) -> str:
    """The longest of the endings that the word has."""
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _has_vowel(part: str) -> bool:
    return any(c in VOWEL for c in part)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The Snowball English stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = word.removeprefix("'")
    w = re.sub(f"(^|[{VOWEL}])y", r"\1Y", w)
    r1 = next((len(p) for p in PREFIXES if w.startswith(p)), None)
    r1 = _region(w, 0) if r1 is None else r1
    r2 = _region(w, r1)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    # 1a: plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _has_vowel(w[:-2]):
        w = w[:-1]
    if w in WHOLE_AFTER_1A:
        return w
    # 1b: past and participle
    end = _ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and _has_vowel(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _SHORT_END.search(w):
            w += "e"
    # 1c: y after a consonant that does not begin the word
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWEL:
        w = w[:-1] + "i"
    # 2 and 3: suffixes within the first region
    end = _ending(w, STEP2)
    if end and len(w) - len(end) >= r1:
        before = w[: -len(end)]
        if (end != "ogi" or before.endswith("l")) and (end != "li" or before[-1:] in tuple(LI_AFTER)):
            w = before + STEP2[end]
    end = _ending(w, STEP3)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + STEP3[end]
    # 4: suffixes within the second region
    end = _ending(w, STEP4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    # 5: a last e or l
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT_END.search(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


#: Of a lexeme as many positions count as of the common type, none beyond the last.
MOST_PLACES, LAST_PLACE = 256, 16383

#: Lengths are bounded where an attempt could fail only at a long run's end, so that the time is linear.
TOKEN = re.compile(
    r"""
    (?P<nothing> </?[A-Za-z][^<>]{0,1000}> | <[!?][^<>]{0,1000}> | &(?:\#\d{1,9}|\#[xX][0-9a-fA-F]{1,8}|[A-Za-z]\w{0,30}); )
  | (?P<email> [^\W_][\w.+-]{0,63} @ (?:[^\W_][\w-]{0,62}\.){1,8} [^\W\d_]{2,63} )
  | (?: [A-Za-z][A-Za-z0-9+.-]{0,15}:// )? (?P<host> (?:[^\W_](?:[\w-]{0,61}[^\W_])?\.){1,8} [A-Za-z]{2,63} (?![^\W_]) (?::\d{1,5})? ) (?P<path> /[^\s<>"']* )?
  | (?P<file> (?:/|[^\W\d_][\w.-]{0,99}/) [\w.-]{1,99} (?:/[\w.-]{1,99}){0,50} )
  | (?P<number> (?<![\w.])[-+]? \d{1,30} (?: (?:\.\d{1,30}){1,6} (?:[eE][-+]?\d{1,3})? | [eE][-+]?\d{1,3} )? (?![\w]) )
  | (?P<hyphened> [^\W_]{1,100} (?:-[^\W_]{1,100}){1,20} )
  | (?P<word> [^\W_]+ )
    """,
    re.VERBOSE,
)
_DIGIT = re.compile(r"\d")


def _lexeme(word: str) -> str | None:
    """Of one word: its stem; a word with digits as it is; None for a stop word."""
    return word if _DIGIT.search(word) else None if word in STOP_WORDS else stem(word)


def tokens(text: str):
    """(position, lexeme) of the text's tokens; stop words take a position and give nothing."""
    place = 0
    for m in TOKEN.finditer(text.lower()):
        kind = m.lastgroup
        if kind == "nothing":
            continue
        if kind in ("host", "path"):
            host, path = m["host"], m["path"]
            parts = [host + path, host, path] if path else [host]
        elif kind == "hyphened":
            parts = [_lexeme(m[0]), *map(_lexeme, m[0].split("-"))]
        else:
            parts = [_lexeme(m[0]) if kind == "word" else m[0]]
        for lexeme in parts:
            place += 1
            if lexeme:
                yield min(place, LAST_PLACE), lexeme


def lexemes(text: str | None) -> dict[str, list[int]]:
    """Lexemes with their positions."""
    out: dict[str, list[int]] = {}
    for place, lexeme in tokens(text or ""):
        places = out.setdefault(lexeme, [])
        if len(places) < MOST_PLACES and (not places or places[-1] < place):
            places.append(place)
    return out


def plain_words(text: str | None) -> dict[str, int]:
    """Runs of a-z with their numbers of occurrences: the words of the plain rank."""
    out: dict[str, int] = {}
    for w in re.findall("[a-z]+", (text or "").lower()):
        out[w] = out.get(w, 0) + 1
    return out
