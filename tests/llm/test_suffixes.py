import random
from collections import Counter

import numpy as np
import pytest

from passages.llm import suffixes
from passages.llm.packed import flat
from passages.llm.suffixes import Suffixes, without_repeats


def expected(rows, length):
    texts = [(text or "").encode() for _, text, *_ in rows]
    count = Counter(t[s : s + length] for t in texts for s in range(len(t) - length + 1))
    out = []
    for (doc_id, *_), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if count[t[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        out.append((doc_id, kept, len(t), sum(gone), spans))
    return out


def key(row):
    return (row[0] is None, row[0] or 0, row[1])


def check(docs_of, rows, length, anchor):
    found = [
        (r["id"], bytes(r["kept"]), r["n_bytes"], r["n_removed"], r["n_spans"])
        for r in without_repeats(docs_of(rows), length=length, anchor=anchor).collect()
    ]
    assert sorted(found, key=key) == sorted(expected(rows, length), key=key)


@pytest.mark.parametrize(("length", "anchor"), [(12, 12), (12, 4), (30, 1), (40, 12)])
def test_against_all_windows(docs_of, random_rows, odd_rows, length, anchor):
    check(docs_of, random_rows + [(1000 + (r[0] or 0), *r[1:]) for r in odd_rows], length, anchor)


def test_contexts_counted_by_windows(docs_of, random_rows, monkeypatch):
    monkeypatch.setattr(suffixes, "MAX_SORTED", 2)
    check(docs_of, random_rows, 16, 5)


def test_sorted_in_several_tasks(docs_of, random_rows, monkeypatch):
    monkeypatch.setattr(suffixes, "SORT_BYTES", 500)
    check(docs_of, random_rows, 16, 5)


def test_mergesort_is_the_order_of_the_strings():
    draw = random.Random(2)
    strings = [bytes(draw.choices(b"ab", k=draw.randint(0, 12))) for _ in range(200)]
    group = np.sort(np.array([draw.randint(0, 5) for _ in strings]))
    text = flat(strings)
    order = Suffixes(text.data, text.starts, text.ends).sorted_within(group)
    found = [(group[i], strings[i]) for i in order]
    assert found == sorted(zip(group, strings, strict=True))


def test_empty_table_and_bad_anchor(docs_of):
    assert without_repeats(docs_of([])).collect() == []
    with pytest.raises(ValueError, match="anchor"):
        without_repeats(docs_of([]), length=5, anchor=6)
