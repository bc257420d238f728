import random

import numpy as np
import pytest

from passages.llm import toxicity

BAD = ["idiot", "worthless", "pathetic"]


@pytest.fixture(scope="module")
def tables(spark, docs_of):
    draw = random.Random(8)
    syllables = "on er th ing ly ti an es re ou".split()

    def word():
        return "".join(draw.choices(syllables, k=draw.randint(1, 4)))

    rows, labels = [], []
    for i in range(1200):
        words = [word() for _ in range(draw.randint(20, 200))]
        toxic = draw.random() < 0.25
        if toxic:
            for _ in range(max(2, len(words) // 25)):
                words[draw.randrange(len(words))] = draw.choice(BAD)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs_of(rows), spark.createDataFrame(labels, "doc_id long, toxic int"), rows, dict(labels)


@pytest.fixture(scope="module")
def model(tables):
    docs, labels, *_ = tables
    return toxicity.fit(docs, labels.where(~toxicity.held_out(labels["doc_id"])))


def test_held_out_accuracy(tables, model):
    docs, _, _, labels = tables
    found = toxicity.scores(docs, model)
    found = found.withColumn("held_out", toxicity.held_out(found["id"])).collect()
    right = [r["predicted"] == labels[r["id"]] for r in found if r["held_out"]]
    assert len(right) > 150 and np.mean(right) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)


def test_misspellings_share_subwords(docs_of, model):
    plain = "onth ering lyti anes reou erth only thing tion anre " * 3
    rows = [(1, plain), (2, plain + "idiots worthles pathetics " * 2), (3, plain + "IDIOT, worthless! pathetic? " * 2)]
    found = {r["id"]: r["score"] for r in toxicity.scores(docs_of(rows), model).collect()}
    assert found[1] < 0.5 < found[2] and found[1] < 0.5 < found[3]


def test_fit_is_the_same_in_every_run(tables, model):
    docs, labels, *_ = tables
    again = toxicity.fit(docs.repartition(7), labels.where(~toxicity.held_out(labels["doc_id"])))
    assert np.array_equal(again.logits_of_buckets()[0], model.logits_of_buckets()[0])


def test_scores_are_those_of_the_bags(model):
    texts = ["One two, THREE", "a", "é x" * 40, "w " * 5000, ""]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([0] * 5, pa.int32()), pa.array(texts)], names=["toxic", "text"])
    bags = toxicity.bags(batch)
    values, _ = model.logits_of_buckets()
    plain = [sum(values[b] * s) for b, s in zip(bags["buckets"], bags["shares"], strict=True) for b, s in [(b.values.to_numpy(), s.values.to_numpy())]]
    assert np.allclose(toxicity.log_odds([t.encode() for t in texts], values), plain, atol=1e-4)


def test_odd_rows_and_rows_that_stay(docs_of, odd_rows, model):
    frame = docs_of(odd_rows)
    assert toxicity.scores(frame, model).count() == len(odd_rows)
    kept = toxicity.without_toxic(frame, model)
    assert kept.columns == frame.columns
    scored = [r["predicted"] for r in toxicity.scores(frame, model).collect()]
    assert kept.count() == scored.count(0)
    assert toxicity.scores(docs_of([]), model).collect() == []


def test_without_labels(spark, docs_of):
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs_of([(1, "a"), (2, "b")]), labels)
    assert [r["predicted"] for r in toxicity.scores(docs_of([(1, "a")]), model).collect()] == [0]


def test_the_whole_sample_is_fitted(tables, spark, monkeypatch):
    """1,500 toxic and 4,500 other documents, with every common bucket of theirs and no other."""
    assert toxicity.FIT_ROWS == (1500, 4500)
    docs, labels, rows, known = tables
    seen = []
    monkeypatch.setattr(toxicity, "trained", lambda *given: seen.append(given))
    toxicity.fit(docs.repartition(5), labels, rows=(50, 150))
    toxic, offsets, buckets, shares, common, _ = seen[0]
    assert (toxic == 1).sum() == 50 and (toxic == 0).sum() == 150 and offsets[-1] == len(buckets) == len(shares)
    from collections import Counter

    import pyarrow as pa

    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "xxhash64(doc_id) k", "xxhash64(doc_id, text) h")
    picked = sorted(frame.collect(), key=lambda r: (r["k"], r["doc_id"]))
    picked = [r for label, most in ((1, 50), (0, 150)) for r in [r for r in picked if known[r["doc_id"]] == label][:most]]
    picked.sort(key=lambda r: r["h"])
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 200, pa.int32()), pa.array([r["text"] for r in picked])], names=["toxic", "text"])
    plain = toxicity.bags(batch)["buckets"].to_pylist()
    n = Counter(b for bag in plain for b in bag)
    assert set(np.flatnonzero(common)) == {b for b, k in n.items() if k >= 2}
    assert [buckets[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [[b for b in bag if n[b] >= 2] for bag in plain]
