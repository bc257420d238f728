"""Prompts from questions and their context, and answers from a supplied model."""

from collections.abc import Callable, Iterator
from string import Formatter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passages.operators.embedding import in_calls

PARAGRAPH = "\n\n"

DEFAULT_TEMPLATE = """You are given passages of transcripts, most relevant first, and a request.
Rely on the passages alone; where they do not settle the request, say that they do not.

Passages:
{context}

Request: {input}
Reply:"""
# Prompts per call of the model.
CALL_SIZE = 16


def stuffed(context: Column) -> Column:
    """The texts of a context in its order, a blank line between them."""
    return F.array_join(F.transform(context, lambda passage: passage["content"]), PARAGRAPH)


def filled(template: str, **fields: Column) -> Column:
    """The template with a column in place of each ``{name}``; ``{{`` stands for a brace."""
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            if name not in fields:
                raise ValueError(f"template field {name!r} is not one of {sorted(fields)}")
            parts.append(fields[name])
    return F.concat(*parts) if parts else F.lit("")


def prompts(
    questions: DataFrame, contexts: DataFrame, template: str = DEFAULT_TEMPLATE
) -> DataFrame:
    """``query_id, input, context, prompt`` for each of ``questions(query_id, input)``.

    A question for which nothing was found has an empty context.
    """
    nothing = F.array().cast(contexts.schema["context"].dataType)
    joined = questions.select("query_id", "input").join(contexts, "query_id", "left")
    joined = joined.withColumn("context", F.coalesce("context", nothing))
    return joined.withColumn(
        "prompt", filled(template, context=stuffed(F.col("context")), input=F.col("input"))
    )


def add_answer(
    df: DataFrame,
    make_model: Callable[[], Callable[[list[str]], list[str]]],
    prompt: str = "prompt",
    output: str = "answer",
    call_size: int = CALL_SIZE,
) -> DataFrame:
    """Add the model's answer to each prompt.

    ``make_model()`` runs once per task and returns a function from prompts to answers,
    which is called with at most ``call_size`` prompts. A null prompt is not sent and has
    a null answer. Any error fails the job, and so does a wrong number of answers.
    """

    @F.arrow_udf("string")
    def answer(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make_model()
        for batch in batches:
            asked = batch.drop_null().to_pylist()
            answers = iter([a for _, part in in_calls(model, asked, call_size) for a in part])
            known = batch.is_valid().to_pylist()
            yield pa.array([next(answers) if k else None for k in known], pa.string())

    # Not deterministic, so that a later filter on the answers does not ask again.
    return df.withColumn(output, answer.asNondeterministic()(F.col(prompt)))
