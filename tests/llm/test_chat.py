import pytest

from passages.llm import chat
from passages.llm.chat import conversations

SCHEMA = "conv_id long, turn long, role string, text string, m string, level string, run int"


@pytest.fixture(scope="module")
def talk(spark):
    rows = [
        (1, 0, "user", "How do I sort a table?\n\nIt is large."),
        (1, 1, "assistant", "Use a range partition.\nThen sort each part."),
        (1, 2, "user", "On Monday, Ann wrote:\n> Use a  RANGE partition.\n> Then sort each part.\n\nWhy not one sort?"),
        (1, 3, "assistant", ">> Use a range partition.\n>> Then sort each part.\n> Why not one sort?\nIt would be one task."),
        (1, 4, "user", "> It is large.\nNot that large."),
        (1, 5, "user", "> never said by anyone\nOk"),
        (2, 0, "user", "> Use a range partition.\nFrom another conversation"),
        (2, 1, "user", None),
        (2, 1, "user", ""),
        (2, None, "user", "> From another conversation"),
        (None, 3, "user", "> Not that large."),
        (3, 1, "user", "same"),
        (3, 1, "user", "same"),
        (3, 2, "user", "> same\nand more"),
    ]
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)


def found(frame):
    return {
        (r["conv"], r["turn"], r["text"]): (r["parent_turn"], r["root_turn"], r["depth"], r["n_quotes"], r["n_linked"])
        for r in conversations(frame).collect()
    }


@pytest.mark.parametrize("slice_turns", [1, 2, 4096])
def test_quotes_are_linked_and_removed(talk, monkeypatch, slice_turns):
    monkeypatch.setattr(chat, "SLICE_TURNS", slice_turns)
    rows = found(talk)
    assert rows[1, 0, "How do I sort a table?\n\nIt is large."] == (None, 0, 0, 0, 0)
    assert rows[1, 2, "Why not one sort?"] == (1, 1, 1, 1, 1)
    assert rows[1, 3, "It would be one task."] == (2, 1, 2, 2, 2)
    assert rows[1, 4, "Not that large."] == (0, 0, 1, 1, 1)
    assert rows[1, 5, "Ok"] == (None, 5, 0, 1, 0)
    assert rows[2, 0, "From another conversation"] == (None, 0, 0, 1, 0)
    assert rows[2, None, ""] == (None, None, 0, 1, 0)
    assert rows[None, 3, ""] == (None, 3, 0, 0, 0)
    assert rows[3, 2, "and more"] == (1, 1, 1, 1, 1)
    assert conversations(talk).count() == talk.count()


def test_long_chain_and_a_line_said_by_all(spark):
    rows = [(1, 0, "u", "start 0")] + [(1, i, "u", f"> start {i - 1}\nstart {i}") for i in range(1, 40)]
    rows += [(2, i, "u", "yes" if i % 2 == 0 else "> yes\nno") for i in range(400)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = conversations(frame).collect()
    chain = {r["turn"]: r["depth"] for r in found if r["conv"] == 1}
    assert chain == {i: i for i in range(40)}
    assert all(r["parent_turn"] == r["turn"] - 1 for r in found if r["conv"] == 2 and r["turn"] % 2)


def test_very_long_message_and_empty_table(spark):
    text = "\n".join(f"{'>' * (i % 3)} line {i}" for i in range(3000))
    frame = spark.createDataFrame([(1, 1, "u", text)], "conv_id long, turn long, role string, text string")
    row = conversations(frame).collect()[0]
    assert row["n_quotes"] == 2000 and row["text"].count("\n") == 999
    assert conversations(frame.limit(0)).collect() == []


def test_no_python_in_the_plan(talk):
    plan = conversations(talk)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
