import pytest

from passages.operators.compare import (
    frame_diff,
    frames_equal,
    round_numbers,
    sort_nulls_last,
    with_row_index,
)

SCHEMA = "k string, n double"


def _frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def test_equal_frames_in_any_order(spark):
    left = _frame(spark, [("a", 1.0), (None, 2.0), ("a", 1.0)])
    assert frames_equal(left, _frame(spark, [(None, 2.0), ("a", 1.0), ("a", 1.0)]))


def test_copies_count(spark):
    left = _frame(spark, [("a", 1.0), ("a", 1.0), ("b", 1.0)])
    right = _frame(spark, [("a", 1.0), ("b", 1.0), ("b", 1.0)])
    assert not frames_equal(left, right)
    assert sorted(map(tuple, frame_diff(left, right).collect())) == [
        ("a", 1.0, "left", 1),
        ("b", 1.0, "right", 1),
    ]


def test_rounding(spark):
    left, right = _frame(spark, [("a", 1.001)]), _frame(spark, [("a", 1.002)])
    assert not frames_equal(left, right)
    assert frames_equal(left, right, digits=2)
    assert round_numbers(_frame(spark, [("a", 2.345678)])).first()["n"] == 2.35


def test_schemas_must_agree(spark):
    left, right = _frame(spark, [("a", 1.0)]), _frame(spark, [("a", 1)], "k string, n int")
    assert not frames_equal(left, right)
    with pytest.raises(ValueError):
        frame_diff(left, right)


def test_nulls_sort_last(spark):
    rows = [(None, 1.0), ("b", None), ("a", 2.0), ("b", 0.0)]
    assert [tuple(r) for r in sort_nulls_last(_frame(spark, rows)).collect()] == [
        ("a", 2.0), ("b", 0.0), ("b", None), (None, 1.0),
    ]


def test_row_index_over_partitions_and_copies(spark):
    df = spark.range(3000, numPartitions=7).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 5 ELSE cast(id AS int) END AS k", "'x' AS x"
    )
    rows = sorted((r["row_index"], r["k"]) for r in with_row_index(df, ["k"]).collect())
    assert [i for i, _ in rows] == list(range(3000))
    assert [k for _, k in rows] == sorted(k for _, k in rows)


def test_comparison_in_order(spark):
    left = _frame(spark, [("a", 1.0), ("b", 2.0)])
    assert frames_equal(left, _frame(spark, [("b", 2.0), ("a", 1.0)]), order=["n"])
    assert not frames_equal(left, _frame(spark, [("b", 1.0), ("a", 2.0)]), order=["n"])
