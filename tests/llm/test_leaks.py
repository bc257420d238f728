import random

import numpy as np
import pytest

from passages.llm import leaks as module
from passages.llm.leaks import Index, leaks, question_and_answer, without_leaks

draw = random.Random(3)
VOCABULARY = ["".join(draw.choices(["on", "er", "th", "ing", "ly", "ti", "an"], k=draw.randint(1, 3))) for _ in range(300)]


def sentence(n):
    return " ".join(draw.choices(VOCABULARY, k=n)).capitalize() + "."


ITEMS = [(i, " ".join(sentence(draw.randint(6, 14)) for _ in range(draw.randint(1, 3)))) for i in range(30)]


@pytest.fixture(scope="module")
def items(spark):
    rows = [*ITEMS, (100, None), (101, ""), (102, "!!!"), (103, ITEMS[0][1])]
    return spark.createDataFrame([(*r, 1) for r in rows], "item_id long, text string, id int")


@pytest.fixture(scope="module")
def rows():
    clean = [sentence(draw.randint(3, 400)) for _ in range(150)]
    rows = [(i, text) for i, text in enumerate(clean)]
    for i, (_, text) in enumerate(ITEMS):
        rows.append((1000 + i, f"{clean[i]} {text} {clean[-i]}"))
        rows.append((2000 + i, f"{clean[i]}\n{text.upper().replace(' ', '  ')}"))
    return [*rows, (5000, ITEMS[3][1] + " " + sentence(300) + ITEMS[4][1]), (6000, None), (6001, "")]


def test_planted_items_are_found_and_no_others(docs_of, items, rows):
    found = {(r["id"], r["item_id"]) for r in leaks(docs_of(rows), items).collect()}
    planted = {(base + i, i) for base in (1000, 2000) for i in range(len(ITEMS))} | {(5000, 3), (5000, 4)}
    planted |= {(1000, 103), (2000, 103)}
    assert found == planted


def test_shards_find_the_same(docs_of, items, rows, monkeypatch):
    whole = sorted(map(tuple, leaks(docs_of(rows), items).collect()))
    monkeypatch.setattr(module, "SHARD_BYTES", 1500)
    parts = leaks(docs_of(rows), items).collect()
    assert [r[:2] for r in sorted(map(tuple, parts))] == [r[:2] for r in whole]
    assert without_leaks(docs_of(rows), items).count() == 152


def test_half_an_item_and_a_question_without_its_answer(docs_of, spark):
    item = "One two three four five six seven eight nine ten. Blue green red."
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [
        (1, "x y one two three four five six seven eight nine ten blue green red z"),
        (2, "One two three four five six seven eight nine ten. Something else."),
        (3, "One two three four five. Blue green red."),
    ]
    assert [r["id"] for r in leaks(docs_of(rows), items).collect()] == [1]


def test_prose_cut_before_or_altered_in_its_last_sentence(docs_of, spark):
    prose = "One two three four five six seven eight nine ten. Blue green red sun moon star sea sky hill lake. Ñ."
    asked = "Which of all the rivers in the old north is longest by far?\nAnswer: Volga"
    items = spark.createDataFrame([(1, prose), (2, asked)], "item_id long, text string")
    cut = prose[: prose.rindex(".", 0, -1)]
    rows = [
        (1, f"x y {cut} z"),
        (2, f"x y {cut}. Other."),
        (3, prose[: prose.index(".")]),
        (4, asked.replace("Volga", "none")),
        (5, asked),
    ]
    found = {(r["id"], r["item_id"]) for r in leaks(docs_of(rows), items).collect()}
    assert found == {(1, 1), (2, 1), (5, 2)}
    assert sorted(r["doc_id"] for r in without_leaks(docs_of(rows), items).collect()) == [3, 4]


def test_block_max_wand_gives_all_above_the_threshold(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(module, "BLOCK_ITEMS", 3)
    random_ = np.random.default_rng(1)
    impacts = random_.random((40, 60)) * (random_.random((40, 60)) < 0.2)
    item, term = np.nonzero(impacts)
    postings = pa.table({"id": item, "term": [f"t{t}" for t in term], "impact": impacts[item, term]})
    index = Index(list(range(40)), ["a b."] * 40, postings)
    places = {int(h): n for n, h in enumerate(index.terms)}
    hashes = module.terms_of([f"t{t}".encode() for t in range(60)]).hashes
    own = impacts / impacts.sum(axis=1, keepdims=True)
    for _ in range(100):
        chosen = np.flatnonzero(random_.random(60) < random_.random())
        chosen = [t for t in chosen if int(hashes[t]) in places]
        terms = [places[int(hashes[t])] for t in chosen]
        score = own[:, chosen].sum(axis=1)
        wanted = {i for i in range(40) if score[i] >= module.RETRIEVED - 1e-9}
        assert {i for i, _ in index.retrieve(terms)} == wanted
        pairs = np.array(sorted(terms), np.int64)
        possible = index.may_retrieve(np.zeros(len(pairs), np.int64), pairs, 1)
        assert possible[0] or not wanted


def test_parts_of_an_item():
    assert question_and_answer("What is it? A thing.") == ("What is it? ", "A thing.")
    assert question_and_answer("What?\nAnswer: four") == ("What?\n", " four")
    assert question_and_answer("no end") == ("no end", "")


def test_odd_rows_and_empty_tables(docs_of, odd_rows, items, spark):
    frame = docs_of(odd_rows)
    assert leaks(frame, items).collect() == []
    assert without_leaks(frame, items).count() == len(odd_rows)
    none = spark.createDataFrame([], "item_id long, text string")
    assert leaks(frame, none).collect() == [] and without_leaks(frame, none).columns == frame.columns
    assert leaks(docs_of([]), items).collect() == []
