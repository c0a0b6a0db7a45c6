import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

WORDS = "alder birch cedar dogwood elder fir ginkgo hazel ivy juniper katsura larch maple nutmeg oak pine quince rowan spruce tulip".split()


def sentence(seed, n):
    """n words that depend on the seed only."""
    out = []
    x = seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 16) % 20] + str((x >> 8) % 50))
    return " ".join(out)


def nasty_rows():
    """Nulls, empty and long texts, ties, repeated rows; columns named like the operators' own."""
    base = sentence(1, 60)
    words = base.split()
    near = " ".join(words[:55] + ["changed"] + words[56:])
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (2, base, "en", "a"),
        (3, near, "de", "a"),
        (4, None, None, None),
        (5, "", "en", "b"),
        (6, "   \n\t ", "de", "b"),
        (None, sentence(2, 40), "en", "b"),
        (None, sentence(2, 40), "en", "b"),
        (7, "one two", "en", "c"),
        (8, "One TWO", "en", None),
        (9, sentence(3, 30_000), "de", "c"),
        (10, "x" * 250 + "y", "en", "c"),
        (11, "z" + "x" * 250, "en", "c"),
        (12, "mail a.b@c.example.org or +1 (555) 123-4567, 4111 1111 1111 1111, 10.0.0.255 é", "en", "c"),
        (13, "1.2.3.4.5.6.7.256 a@b 4111-1111-1111-1112 +12 \x01 5\x016", "en", "c"),
        (14, "ünïcödé ² " + sentence(4, 8), None, "c"),
        (15, "!!! 123 ²", "en", "c"),
    ]
    return [(i, t, lang, s, len(t) if t else None, "k", 1.0, ["q"], {"m": 1}) for i, t, lang, s in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score double, spans array<string>, size map<string,int>"


@pytest.fixture(scope="session")
def nasty(spark):
    return spark.createDataFrame(nasty_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
