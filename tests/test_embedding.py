import math
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.errors import PythonException

from passages.operators.embedding import (
    _call,
    add_embedding,
    add_lexical_embedding,
    failed_embeddings,
    lexical_model,
    valid_embeddings,
)

# The models below travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _texts(spark, texts, partitions=1):
    rows = list(enumerate(texts))
    return spark.createDataFrame(rows, "id int, content string").repartition(partitions)


def _vectors(df):
    return [r["embedding"] for r in df.orderBy("id").collect()]


def test_golden_vectors(spark, golden, make_fake_model):
    _, parts, expected = golden
    df = add_embedding(_texts(spark, parts, 2), make_fake_model)
    assert df.schema["embedding"].dataType.simpleString() == "array<float>"
    assert np.allclose(_vectors(df), expected, atol=1e-6)


def test_calls_hold_at_most_150_texts(spark):
    def make():
        return lambda texts: [[float(len(texts))]] * len(texts)

    sizes = [v[0] for v in _vectors(add_embedding(_texts(spark, ["x"] * 400), make))]
    assert sorted(set(sizes)) == [100.0, 150.0]
    assert _vectors(add_embedding(_texts(spark, ["x"] * 5), make, call_size=2))[0] == [2.0]


def _make_picky():
    def embed(texts):
        if "bad" in texts:
            raise ValueError("bad text")
        if "fatal" in texts:
            raise RuntimeError("no service")
        return [[1.0]] * len(texts)

    return embed


def test_value_error_nulls_the_call(spark):
    df = add_embedding(_texts(spark, ["a", "bad", "c", "d"]), _make_picky, call_size=2)
    assert failed_embeddings(df).count() == 2
    one_by_one = add_embedding(
        _texts(spark, ["a", "bad", "c", "d"]), _make_picky, call_size=2, retry_one_by_one=True
    )
    assert [r["content"] for r in failed_embeddings(one_by_one).collect()] == ["bad"]


def test_other_errors_fail_the_job(spark):
    with pytest.raises(PythonException, match="no service"):
        add_embedding(_texts(spark, ["fatal"]), _make_picky).collect()


@pytest.mark.parametrize("n", [0, 1, 3])
def test_a_wrong_number_of_vectors_fails_the_job(spark, n):
    def make():
        return lambda texts: [[1.0]] * n

    with pytest.raises(PythonException, match=f"{n} results for 2 texts"):
        add_embedding(_texts(spark, ["a", "b"]), make, call_size=2).collect()


def test_counts_in_tiles(monkeypatch):
    from passages.operators import embedding

    whole = lexical_model(32)(["a b c", "", "b b", "d e f g"])
    monkeypatch.setattr(embedding, "_TILE", 40)
    assert np.allclose(lexical_model(32)(["a b c", "", "b b", "d e f g"]), whole)


def test_null_texts_are_not_sent(spark):
    df = add_embedding(_texts(spark, ["a", None, "b"]), _make_picky)
    assert _vectors(df) == [[1.0], None, [1.0]]


def test_filter_on_vectors_calls_the_model_once(spark):
    df = failed_embeddings(add_embedding(_texts(spark, ["a"]), _make_picky))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_lexical_vectors(spark):
    texts = ["The cat the Cat", "", None, "éa ça\nÇA"]
    native = _vectors(add_lexical_embedding(_texts(spark, texts), 16))
    model = lexical_model(16)(["The cat the Cat", "", "éa ça\nÇA"])
    assert native[2] is None and native[1] == [0.0] * 16
    assert np.allclose([native[0], native[1], native[3]], model)
    assert math.isclose(sum(x * x for x in native[0]), 1.0, rel_tol=1e-6)


def test_valid_embeddings(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [])], "id int, embedding array<float>"
    )
    assert [r["id"] for r in valid_embeddings(df, 2).collect()] == [1]


def test_failed_calls_are_narrowed_down_by_halves():
    texts = [f"t{i}" for i in range(128)]
    for refused in ([], ["t5"], ["t0", "t127"], texts):
        calls = []

        def model(asked, refused=refused, calls=calls):
            calls.append(len(asked))
            if set(asked) & set(refused):
                raise ValueError
            return [[1.0]] * len(asked)

        found = _call(model, texts, True)
        assert [v is None for v in found] == [t in refused for t in texts]
        assert len(calls) <= 1 + 2 * 7 * len(refused)
    assert _call(model, texts, False) == [None] * 128  # not made again unless asked to
