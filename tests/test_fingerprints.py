import pytest
from pyspark.sql import functions as F

from passages.operators import fingerprints
from passages.operators.compare import frame_diff
from passages.operators.fingerprints import keyed_diff

SCHEMA = "k string, n double, t string"


def _rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(f"k{i % 700}", float(i % 13), None if i % 5 else "x") for i in range(3000)]
    rows += [(None, None, "x"), (None, None, "x"), ("k1", None, None), ("", 0.0, "")] + [("hot", 1.0, "h")] * 500
    other = list(rows)
    other[5] = (other[5][0], 99.0, other[5][2])
    other[20] = (other[20][0], other[20][1], None)
    other.remove((None, None, "x"))
    other.append(("hot", 1.0, "h"))
    other.append(("new", 1.0, None))
    other.append(("swap", None, "a"))
    rows.append(("swap", None, None))
    return tuple(spark.createDataFrame(r, SCHEMA).repartition(3) for r in (rows, other))


@pytest.mark.parametrize("options", [{}, {"bits": 2, "most_rows": 40}, {"bits": 1, "most_rows": 0}, {"most_rows": 0}])
def test_equal_to_the_plain_difference(tables, options):
    left, right = tables
    wanted = _rows(frame_diff(left, right))
    assert len(wanted) >= 8
    assert _rows(keyed_diff(left, right, ["k"], **options)) == wanted
    assert _rows(keyed_diff(left, left.repartition(2, "n"), ["k"], **options)) == []


def test_rows_that_are_compared_follow_the_difference(tables, monkeypatch):
    left, right = tables
    compared = []
    plain = frame_diff

    def watched(a, b):
        compared.append(a.count() + b.count())
        return plain(a, b)

    monkeypatch.setattr(fingerprints, "frame_diff", watched)
    few = right.where("k <> 'hot'")
    assert keyed_diff(left.where("k <> 'hot'"), few, ["k"], most_rows=100).count() >= 7
    assert compared[0] < 150  # of 6,000


def test_nulls_in_other_columns_differ(spark):
    rows = spark.createDataFrame([("a", None, "a")], "k string, x string, y string")
    swapped = spark.createDataFrame([("a", "a", None)], "k string, x string, y string")
    assert keyed_diff(rows, swapped, ["k"]).count() == 2


def test_rounding_and_bad_arguments(spark, tables):
    left = tables[0]
    near = left.withColumn("n", F.col("n") + 0.001)
    assert keyed_diff(left, near, ["k"]).count() > 0
    assert keyed_diff(left, near, ["k"], digits=2).count() == 0
    for right, keys, message in ((left.select("k"), ["k"], "schemas"), (left, [], "no keys")):
        with pytest.raises(ValueError, match=message):
            keyed_diff(left, right, keys)
    with pytest.raises(ValueError, match="bits"):
        keyed_diff(left, left, ["k"], bits=17)
    none = left.where("false")
    assert keyed_diff(none, none, ["k"]).count() == 0
    assert keyed_diff(none, left, ["k"]).agg(F.sum("copies")).first()[0] == left.count()
