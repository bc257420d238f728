import numpy as np
import pytest

from passages.operators import pivots
from passages.operators.pivots import finite_vectors, join_nearest
from tests.test_search import _frame, _rows, brute_force


@pytest.fixture(scope="module")
def clusters():
    """Vectors around few places, a third of them equal, and questions beside them."""
    draw = np.random.default_rng(3)
    places = draw.normal(0, 20, size=(12, 6))
    vectors = places[draw.integers(0, 12, 900)] + draw.normal(0, 1, (900, 6))
    vectors[:300] = places[0]
    questions = places[draw.integers(0, 12, 150)] + draw.normal(0, 1, (150, 6))
    questions[:50] = places[0]
    return list(range(150)), questions, [f"v{i:03d}" for i in draw.permutation(900)], vectors


def _join(spark, data, k, dim, **options):
    query_ids, questions, ids, vectors = data
    return join_nearest(
        _frame(spark, "query_id", query_ids, questions), _frame(spark, "id", ids, vectors), dim, k, **options
    )


@pytest.mark.parametrize("k", [1, 5, 350])
@pytest.mark.parametrize("sizes", [{}, {"pivots": 40, "block_questions": 20, "block_bytes": 4096}])
def test_against_brute_force(spark, clusters, k, sizes):
    assert _rows(_join(spark, clusters, k, 6, **sizes)) == sorted(brute_force(*clusters, k))


def test_fewer_vectors_than_asked_for(spark, clusters):
    query_ids, questions, ids, vectors = clusters
    few = query_ids, questions, ids[:3], vectors[-3:]
    assert _rows(_join(spark, few, 5, 6)) == sorted(brute_force(*few, 5))


def test_vectors_go_only_to_blocks_within_reach(spark, clusters, monkeypatch):
    seen = {}
    dealt = pivots._to_blocks

    def counted(*args):
        rows = dealt(*args)
        seen["copies"], seen["blocks"] = rows.count(), len(args[2])
        return rows

    monkeypatch.setattr(pivots, "_to_blocks", counted)
    query_ids, questions, ids, vectors = clusters
    found = _join(spark, clusters, 5, 6, pivots=200, block_questions=10)
    assert _rows(found) == sorted(brute_force(*clusters, 5))
    assert seen["blocks"] > 10
    assert seen["copies"] < 900 * seen["blocks"] / 3


def test_odd_vectors(spark):
    ids = list(range(6))
    vectors = [[0, 0], [1, 0], None, [float("nan"), 1], [1], [float("inf"), 0]]
    frame = _frame(spark, "id", ids, vectors)
    asked = frame.withColumnRenamed("id", "query_id")
    found = [(r["query_id"], r["id"], r["distance"]) for r in join_nearest(asked, frame, 2, 2).collect()]
    assert sorted(found) == [(0, 0, 0.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 0.0)]
    assert finite_vectors(frame, 2).count() == 2
    empty = join_nearest(asked, frame, 7, 2)
    assert empty.columns == ["query_id", "id", "distance", "rank"] and empty.count() == 0
    assert join_nearest(asked.where("false"), frame, 2).count() == 0
