import re

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from passages.functions.text import PRETOKEN, WHITESPACE
from passages.operators.chunking import (
    PythonCounter,
    chunk_content,
    chunk_words,
    token_passages,
    word_passages,
)

# Python's \s takes in more characters than Java's.
BLANK = r" \t\n\x0b\f\r"
TOKENS = regex.compile(PRETOKEN.replace(r"[^\s", "[^" + BLANK).replace(r"|\s+", f"|[{BLANK}]+"))


def count(text):
    return len(TOKENS.findall(text))


def brute_force(text, size, overlap):
    """Passages by the rule in words: pieces are dropped and added one at a time."""
    if text == "":
        return [""]

    def pieces_of(text):
        if count(text) <= size:
            return [text]
        for pattern in ("(?= )", "(?=\n)"):
            parts = [p for p in re.split(pattern, text) if p]
            if len(parts) > 1:
                return [q for p in parts for q in pieces_of(p)]
        return list(text)

    passages, current = [], []
    for piece in pieces_of(text):
        held = sum(map(count, current))
        if held + count(piece) > size:
            passages.append("".join(current).strip())
            while held > overlap or held + count(piece) > size:
                held -= count(current.pop(0))
        current.append(piece)
    passages.append("".join(current).strip())
    return [p for p in passages if p]


def _content(spark, texts):
    return spark.createDataFrame(
        [("c", str(i), text) for i, text in enumerate(texts)],
        "channel_id string, video_id string, content string",
    )


def _passages(df):
    return [r["passages"] for r in df.orderBy(df["video_id"].cast("int")).collect()]


def test_golden_passages(spark, golden):
    text, expected, _ = golden
    rows = chunk_content(_content(spark, [text]), 25, 5).orderBy("id").collect()
    assert [r["content"] for r in rows] == expected
    assert [r["id"] for r in rows] == [f"c_0_{i}" for i in range(4)]


def test_short_texts(spark):
    texts = ["", None, "  \n ", " one  two ", "x"]
    assert _passages(token_passages(_content(spark, texts), chunk_size=25, chunk_overlap=5)) == [
        [""], None, [], ["one  two"], ["x"],
    ]
    ids = [r["id"] for r in chunk_content(_content(spark, texts), 25, 5).collect()]
    assert sorted(ids) == ["c_0_0", "c_3_0", "c_4_0"]


def test_long_pieces_are_split_at_line_ends_then_characters(spark):
    lines = "\n".join("!a!b!c" for _ in range(6))
    solid = "1" * 100
    texts = [lines, solid, f"x {solid}\ny", "a b " + lines + " c"]
    found = _passages(token_passages(_content(spark, texts), chunk_size=8, chunk_overlap=2))
    assert found == [brute_force(t, 6, 2) for t in texts]
    assert all(p in t for t, ps in zip(texts, found) for p in ps)


def test_characters_outside_the_basic_plane(spark):
    text = "\U0001f600a" * 30
    found = _passages(token_passages(_content(spark, [text]), chunk_size=7, chunk_overlap=0))
    assert "".join(found[0]) == text


def test_random_texts_match_brute_force(spark):
    alphabet = st.sampled_from(list("ab1é '!\n\t") + ["it's", " ", " ", "word", "\xa0", "\U0001f600"])
    texts = st.lists(st.lists(alphabet, max_size=120).map("".join), min_size=200, max_size=200)

    @settings(max_examples=3, deadline=None)
    @given(texts, st.integers(4, 20), st.integers(0, 5))
    def check(texts, size, overlap):
        overlap = min(overlap, size - 3)
        df = token_passages(_content(spark, texts), chunk_size=size, chunk_overlap=overlap)
        assert _passages(df) == [brute_force(t, size - 2, overlap) for t in texts]

    check()


def test_python_tokenizer(spark, golden):
    text, expected, _ = golden
    pattern = PRETOKEN

    def make():
        import regex

        return regex.compile(pattern).findall

    df = token_passages(_content(spark, [text, "", None]), "content", 25, 5, PythonCounter(make))
    assert _passages(df) == [expected, [""], None]


def test_tokenizer_of_words_gives_word_passages(spark):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (1, 7, 8, 9, 20, 101)]
    by_tokens = token_passages(
        _content(spark, texts), "content", 10, 3, PythonCounter(lambda: str.split)
    )
    by_words = word_passages(_content(spark, texts), "content", 8, 3)
    assert _passages(by_tokens) == _passages(by_words)


def test_word_passages(spark):
    texts = ["a b c d e f g", "a\tb\n\nc", "", None]
    found = _passages(word_passages(_content(spark, texts), "content", 3, 1))
    assert found == [["a b c", "c d e", "e f g"], ["a b c"], [""], None]
    assert chunk_words(_content(spark, texts), 3, 1).count() == 5


@pytest.mark.parametrize("size, overlap", [(10, 8), (10, -1), (2, 0)])
def test_overlap_must_leave_room(spark, size, overlap):
    with pytest.raises(ValueError):
        token_passages(_content(spark, ["x"]), "content", size, overlap)


def test_stripped_characters():
    assert set(WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}
