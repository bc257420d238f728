import numpy as np
import pytest

from passages.operators import codes as module
from passages.operators.cells import fit_cells
from passages.operators.codes import fit_codes, read_codes, search_codes, write_codes
from passages.operators.hits import hit_schema
from tests.test_search import _frame, _rows, brute_force


@pytest.fixture(scope="module")
def clusters():
    draw = np.random.default_rng(6)
    places = draw.normal(0, 4, size=(10, 12))
    vectors = places[draw.integers(0, 10, 1500)] + draw.normal(0, 1, (1500, 12))
    vectors[:500] = places[0]
    questions = places[draw.integers(0, 10, 60)] + draw.normal(0, 1, (60, 12))
    return list(range(60)), questions, [f"v{i:04d}" for i in draw.permutation(1500)], vectors


@pytest.fixture(scope="module")
def fitted(spark, clusters):
    frame = _frame(spark, "id", clusters[2], clusters[3])
    return fit_codes(fit_cells(frame, 12, 9), parts=5)


def _asked(spark, clusters):
    return _frame(spark, "query_id", clusters[0], clusters[1])


def test_all_candidates_give_the_exact_result(spark, clusters, fitted):
    found = search_codes(_asked(spark, clusters), fitted, 5, first_cells=9, candidates=300)
    assert _rows(found) == sorted(brute_force(*clusters, 5))


def test_few_candidates_find_nearly_all_with_exact_distances(spark, clusters, fitted):
    exact = {(q, i): d for q, i, d, _ in brute_force(*clusters, 5)}
    found = _rows(search_codes(_asked(spark, clusters), fitted, 5, first_cells=4, candidates=8))
    assert len(found) == 300
    right = [(q, i) for q, i, _, _ in found if (q, i) in exact]
    # Equal vectors tie: any of them is as near as the ones with the least ids.
    nearest = {(q, rank): d for q, _, d, rank in brute_force(*clusters, 5)}
    assert sum(nearest[q, rank] == d for q, _, d, rank in found) >= 0.9 * 300
    assert all(exact[q, i] == d for q, i, d, _ in found if (q, i) in right)


def test_small_blocks_give_the_same(spark, clusters, fitted, monkeypatch):
    wanted = _rows(search_codes(_asked(spark, clusters), fitted, 3, first_cells=5, candidates=10))
    monkeypatch.setattr(module, "BLOCK_BYTES", 4 * 5 * 50)
    monkeypatch.setattr(module, "_TILE", 300)
    found = _rows(search_codes(_asked(spark, clusters), fitted, 3, first_cells=5, candidates=10))
    assert [(q, d, r) for q, _, d, r in found] == [(q, d, r) for q, _, d, r in wanted]


def test_stored_codes_give_the_same(spark, clusters, fitted, tmp_path):
    write_codes(fitted, str(tmp_path))
    stored = read_codes(spark, str(tmp_path))
    assert np.array_equal(stored.books, fitted.books)
    asked = _asked(spark, clusters)
    options = {"first_cells": 3, "candidates": 10}
    assert _rows(search_codes(asked, stored, 4, **options)) == _rows(search_codes(asked, fitted, 4, **options))
    codes = stored.rows.collect()
    assert {len(r["code"]) for r in codes} == {5} and len(codes) == 1500
    plan = stored.rows.where("cell in (1, 2)")._jdf.queryExecution().executedPlan().toString()
    assert "In(cell, [1,2])" in plan


def test_rounds_lower_the_error(clusters, spark):
    cells = fit_cells(_frame(spark, "id", clusters[2], clusters[3]), 12, 9)
    books = module._first_books(cells, 5)
    errors = []
    for _ in range(3):
        books, error = module._round(cells.vectors, cells.centers, books)
        errors.append(error)
    assert errors[0] > errors[1] > errors[2]


def test_few_vectors_and_none(spark, clusters):
    ids = clusters[2][:7]
    cells = fit_cells(_frame(spark, "id", ids, clusters[3][-7:]), 12, 2)
    found = search_codes(_asked(spark, clusters), fit_codes(cells, parts=12), 9, first_cells=2)
    assert _rows(found) == sorted(brute_force(*clusters[:2], ids, clusters[3][-7:], 9))
    none = fit_codes(fit_cells(_frame(spark, "id", ids, clusters[3][-7:]).where("false"), 12), parts=4)
    assert search_codes(_asked(spark, clusters), none, 9).count() == 0
    assert search_codes(_asked(spark, clusters).where("false"), none).count() == 0
    with pytest.raises(ValueError, match="parts"):
        fit_codes(cells, parts=13)
    assert hit_schema(_asked(spark, clusters), cells.vectors)
