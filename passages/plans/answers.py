"""Answers to a table of questions: retrieve, build the prompt, generate."""

from pyspark.sql import DataFrame

from passages.operators.cells import Cells
from passages.operators.context import CONTEXT_FIELDS, contexts, last_of_repeated, retrieved
from passages.operators.prompts import DEFAULT_TEMPLATE, add_answer, prompts
from passages.operators.search import nearest_passages


def question_prompts(
    questions: DataFrame,
    passages: DataFrame,
    k: int = 5,
    template: str = DEFAULT_TEMPLATE,
    fields: tuple[str, ...] = CONTEXT_FIELDS,
    last_by: list[str] | None = None,
    cells: Cells | None = None,
    first_cells: int = 4,
    complete: bool = True,
) -> DataFrame:
    """``query_id, input, context, prompt`` for ``questions(query_id, input, embedding)``.

    ``passages`` hold ``id``, ``embedding`` and the fields of a context row. Of rows that
    repeat an id, the last by ``last_by`` counts, in the search and in the context. With
    ``cells``, fitted with the same ``last_by``, questions are answered from them,
    approximately if not ``complete``.
    """
    if cells is None:
        passages = last_of_repeated(passages, last_by)
    hits = nearest_passages(
        questions, passages, k, cells=cells, first_cells=first_cells, complete=complete
    )
    found = contexts(retrieved(hits, passages, fields, last_by), fields)
    return prompts(questions, found, template)


def answer_questions(questions: DataFrame, passages: DataFrame, make_model, **options) -> DataFrame:
    """``query_id, input, context, answer``; a context row has no distance."""
    answered = add_answer(question_prompts(questions, passages, **options), make_model)
    return answered.select("query_id", "input", "context", "answer")
