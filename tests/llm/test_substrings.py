import re
from collections import Counter

import pytest

from passages.llm import exchange
from passages.llm.substrings import without_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(rows, length):
    texts = [WORD.findall(text or "") for _, text, *_ in rows]
    count = Counter(tuple(w[s : s + length]) for w in texts for s in range(len(w) - length + 1))
    out = []
    for (doc_id, *_), w in zip(rows, texts, strict=True):
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            if count[tuple(w[s : s + length])] > 1:
                gone[s : s + length] = [True] * length
        out.append((doc_id, " ".join(x for x, g in zip(w, gone, strict=True) if not g), len(w), sum(gone)))
    return out


def key(row):
    return (row[0] is None, row[0] or 0, row[1])


@pytest.mark.parametrize("length", [1, 3, 8])
def test_against_all_windows(docs_of, random_rows, odd_rows, length):
    rows = random_rows + [(1000 + (r[0] or 0), *r[1:]) for r in odd_rows]
    found = [tuple(r) for r in without_repeats(docs_of(rows), length=length).collect()]
    assert sorted(found, key=key) == sorted(expected(rows, length), key=key)


def test_with_a_sketch_that_overestimates_everything(docs_of, random_rows, monkeypatch):
    monkeypatch.setattr("passages.llm.substrings.counter_bits", lambda keys: 2)
    found = [tuple(r) for r in without_repeats(docs_of(random_rows), length=4).collect()]
    assert sorted(found) == sorted(expected(random_rows, 4))


def test_with_many_ranges(docs_of, random_rows, monkeypatch):
    monkeypatch.setattr(exchange, "BLOCK_KEYS", 64)
    found = [tuple(r) for r in without_repeats(docs_of(random_rows), length=4).collect()]
    assert sorted(found) == sorted(expected(random_rows, 4))


def test_empty_table(docs_of):
    assert without_repeats(docs_of([])).collect() == []
