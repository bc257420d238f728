import random
import re

import pytest

from passages.llm import jaccard
from passages.llm.components import components
from passages.llm.exact import LOWER, UPPER
from passages.llm.jaccard import shingle_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def expected(rows, size=5, percent=80):
    sets = {}
    for doc_id, text, *_ in rows:
        w = WORD.findall((text or "").translate(str.maketrans(UPPER, LOWER)))
        sets[doc_id] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    ids = sorted(sets)
    links = [
        (a, b)
        for i, a in enumerate(ids)
        for b in ids[i + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    root = roots(ids, links)
    return sorted((i, len(sets[i]), root[i]) for i in ids), len(links)


def near_copies(seed, groups=12, copies=14, words=60):
    """Chains and stars of copies around the threshold."""
    draw = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{draw.randint(0, 400)}" for _ in range(draw.randint(6, words))]
        texts = [base]
        for _ in range(copies):
            text = list(draw.choice(texts) if draw.random() < 0.5 else base)
            for _ in range(draw.randint(0, 2)):
                text[draw.randrange(len(text))] = f"x{draw.randint(0, 10_000)}"
            texts.append(text)
        rows += [" ".join(t) for t in texts]
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_pairs(docs_of, seed):
    rows = near_copies(seed)
    wanted, links = expected(rows)
    assert links > 100
    assert sorted(map(tuple, shingle_components(docs_of(rows)).collect())) == wanted


def test_single_words_and_other_thresholds(docs_of, random_rows):
    wanted, _ = expected(random_rows, 1, 60)
    found = shingle_components(docs_of(random_rows), size=1, percent=60)
    assert sorted(map(tuple, found.collect())) == wanted


def test_lists_in_parts(docs_of, random_rows, monkeypatch):
    monkeypatch.setattr(jaccard, "PART", 7)
    monkeypatch.setattr(jaccard, "HUB_SETS", 3)
    monkeypatch.setattr(jaccard, "TASK_ENTRIES", 50)
    wanted, _ = expected(random_rows, 2, 50)
    found = shingle_components(docs_of(random_rows), size=2, percent=50)
    assert sorted(map(tuple, found.collect())) == wanted


def test_odd_rows(docs_of, odd_rows):
    rows = [r for r in odd_rows if r[0] is not None]
    wanted, _ = expected(rows)
    found = sorted({tuple(r) for r in shingle_components(docs_of(rows)).collect()})
    assert found == wanted
    nameless = shingle_components(docs_of([(None, "a b c"), (None, "")])).collect()
    assert [tuple(r) for r in sorted(nameless, key=repr)] == [(None, 0, None), (None, 1, None)]
    assert shingle_components(docs_of([])).collect() == []


def test_components(spark):
    draw = random.Random(4)
    links = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(200)]
    links += [(i, i + 1) for i in range(1000, 1100)]
    frame = spark.createDataFrame(links, "a long, b long")
    nodes = {n for link in links if link[0] != link[1] for n in link}
    assert {tuple(r) for r in components(frame).collect()} == set(roots(nodes, links and [l for l in links if l[0] != l[1]]).items())
