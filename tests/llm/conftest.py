import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use themselves.
CLASHES = ("id", "g", "s", "n", "size", "slice", "hash", "key", "kept", "copies", "digest", "head", "__id")


def _regular_words():
    """Two words of 1,024 letters that polynomials modulo a power of two cannot tell apart."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from ``(doc_id, text)`` or ``(doc_id, text, source)``, with clashing columns."""

    def make(rows, partitions=3):
        rows = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", None) for r in rows]
        frame = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
        return frame.withColumns({c: F.lit("x") for c in CLASHES})

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, ties, repeated rows, a null id, white space, a very long text."""
    draw = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["É", "the", "THE", "日本"]
    base = " ".join(draw.choices(words, k=60))
    return [
        (0, None, "a"),
        (1, "", "a"),
        (2, " \t\n\r\x0b\x0c ", None),
        (3, base, "b"),
        (4, base, "b"),
        (5, base.upper(), "b"),
        (6, base + " tail", None),
        (7, "head " + base, "c"),
        (7, "head " + base, "c"),
        (8, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "c"),
        (9, "baaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab", "c"),
        (10, "one two", "c"),
        (11, "one  two", "a"),
        (12, "one", "a"),
        (None, "no id " + base, "a"),
        (13, " ".join(draw.choices(words, k=30_000)), "b"),
        (14, " em space stays", "b"),
    ]


@pytest.fixture(scope="session")
def random_rows():
    """Texts of a few words, with pieces copied from one another."""
    draw = random.Random(11)
    words = "the of and to in it is on at by an er th nd ing".split()
    rows = []
    for number in range(160):
        parts = [" ".join(draw.choices(words, k=draw.randint(1, 25)))]
        for _ in range(draw.randint(0, 3)):
            if rows:
                other = draw.choice(rows)[1]
                start = draw.randrange(len(other))
                parts.append(other[start : start + draw.randint(5, 120)])
            parts.append(" ".join(draw.choices(words, k=draw.randint(0, 6))))
        rows.append((number, " ".join(parts), draw.choice(["a", "b", "c", None])))
    return rows
