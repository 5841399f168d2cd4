"""The stemmer against published word and stem pairs, the tokenizer's kinds, and its time on hostile text."""

import time

import pytest

from ragspark.functions import english

# Published pairs of the Snowball English vocabulary.
PAIRS = """
consign consign | consigned consign | consignment consign | consistency consist | consistently consist | consolatory consolatori | consolidating consolid | consolingly consol
conspicuously conspicu | conspiracy conspiraci | conspirators conspir | constable constabl | constancy constanc | knackeries knackeri | knavish knavish | kneeling kneel | knightly knight
knitting knit | knives knive | knocker knocker | generate generat | generally general | generic generic | generous generous | communication communic | community communiti
arsenal arsenal | hoping hope | hopping hop | beautiful beauti | cries cri | ties tie | gas gas | this this | gaps gap | kiwis kiwi | say say | by by | enjoy enjoy | hopefulness hope
youth youth | national nation | rational ration | inning inning | proceed proceed | exceed exceed | dying die | skies sky | news news | happily happili | early earli | only onli
sky sky | bias bias | sized size | agreed agre | controll control | roll roll | hearing hear | studies studi | aids aid
"""


@pytest.mark.parametrize("word, expected", [p.split() for line in PAIRS.split("\n") for p in line.split("|") if p.strip()])
def test_published_pairs(word, expected):
    assert english.stem(word) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("The fat-cat's hats", [(2, "fat-cat"), (3, "fat"), (4, "cat"), (6, "hat")]),
        ("mail foo@bar.com now", [(1, "mail"), (2, "foo@bar.com")]),
        ("see http://example.com/a?b=1.", [(1, "see"), (2, "example.com/a?b=1."), (3, "example.com"), (4, "/a?b=1.")]),
        ("www.x.org and/or 3.14 -12 1e5 abc123", [(1, "www.x.org"), (2, "and/or"), (3, "3.14"), (4, "-12"), (5, "1e5"), (6, "abc123")]),
        ("<b>bold</b> &amp; cafés foo_bar", [(1, "bold"), (2, "café"), (3, "foo"), (4, "bar")]),
        ("", []),
        ("the of and", []),
    ],
)
def test_kinds_of_tokens(text, expected):
    assert list(english.tokens(text)) == expected


def test_places_are_bounded_and_time_is_linear():
    v = english.lexemes("word " * 20_000)
    assert len(v["word"]) == 256 and max(v["word"]) <= 16_383
    for hostile in ("a" * 300_000, "a." * 150_000, "a-" * 150_000, "<a " * 100_000, "a@" * 150_000, "1." * 150_000, "a/" * 150_000, "&a" * 150_000):
        began = time.perf_counter()
        english.lexemes(hostile)
        assert time.perf_counter() - began < 8, hostile[:4]
