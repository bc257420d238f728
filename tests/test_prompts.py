import sys

import pytest
from pyspark import cloudpickle
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from passages.operators.prompts import DEFAULT_TEMPLATE, add_answer, filled, prompts

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture
def questions(spark):
    return spark.createDataFrame([(1, "why 100%?"), (2, "{who}")], "query_id int, input string")


@pytest.fixture
def found(spark):
    return spark.createDataFrame(
        [(1, [("a", "one %s"), ("b", "two")])],
        "query_id int, context array<struct<id:string,content:string>>",
    )


def test_prompts(questions, found):
    template = "{{use}} <{context}> for {input}|{input}"
    rows = prompts(questions, found, template).orderBy("query_id").collect()
    assert rows[0]["prompt"] == "{use} <one %s\n\ntwo> for why 100%?|why 100%?"
    assert rows[1]["prompt"] == "{use} <> for {who}|{who}"
    assert rows[1]["context"] == []


def test_default_template(questions, found):
    row = prompts(questions, found).where("query_id = 1").first()
    assert row["prompt"] == DEFAULT_TEMPLATE.format(context="one %s\n\ntwo", input="why 100%?")


def test_unknown_field():
    with pytest.raises(ValueError, match="topic"):
        filled("{topic}", input=F.col("input"))


def _make_model():
    return lambda texts: [text[::-1] for text in texts]


def test_answers(spark, questions):
    rows = add_answer(questions, _make_model, "input").orderBy("query_id").collect()
    assert [r["answer"] for r in rows] == ["?%001 yhw", "}ohw{"]


def test_calls_are_bounded_and_counted(spark):
    def make():
        return lambda texts: [str(len(texts))] * len(texts)

    frame = spark.createDataFrame([(i, None if i == 3 else "x") for i in range(8)], "id int, prompt string")
    rows = add_answer(frame.coalesce(1), make, call_size=3).orderBy("id").collect()
    assert [r["answer"] for r in rows] == ["3", "3", "3", None, "3", "3", "3", "1"]

    def make_short():
        return lambda texts: texts[1:]

    with pytest.raises(PythonException, match="results for"):
        add_answer(frame, make_short).collect()
