import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passages.operators import cells, context, hits, nearest, search
from passages.operators.cells import fit_cells, read_cells, search_cells, write_cells
from passages.operators.context import contexts, last_of_repeated, repeated_ids, retrieved
from passages.operators.embedding import add_embedding
from passages.operators.hits import hit_schema
from passages.operators.search import nearest_passages, unsearchable
from passages.plans.answers import question_prompts

FIELDS = ("id", "content")


def _frame(spark, key, ids, vectors, partitions=3):
    kind = "string" if isinstance(ids[0], str) else "bigint"
    rows = [(i, None if v is None else [float(x) for x in v]) for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, f"{key} {kind}, embedding array<float>").repartition(
        partitions
    )


def brute_force(query_ids, questions, ids, vectors, k):
    q = np.asarray(questions, np.float32).astype(float)
    v = np.asarray(vectors, np.float32).astype(float)
    found = []
    for query_id, question in zip(query_ids, q):
        distances = np.cumsum((v - question) ** 2, axis=1)[:, -1]
        best = sorted(zip(distances.tolist(), ids))[:k]
        found += [(query_id, i, d, rank) for rank, (d, i) in enumerate(best, 1)]
    return found


def _rows(hits):
    return sorted(
        (r["query_id"], r["id"], r["distance"], r["rank"]) for r in hits.collect()
    )


@pytest.fixture(scope="module")
def grid():
    """Few distinct coordinates, so that many distances are equal, and one vector that
    a third of the ids share."""
    draw = np.random.default_rng(1)
    vectors = draw.integers(0, 4, size=(600, 3)).astype(float)
    vectors[:200] = [1, 2, 3]
    ids = [f"v{i:03d}" for i in draw.permutation(600)]
    questions = np.concatenate([draw.integers(0, 4, size=(30, 3)), draw.normal(2, 2, size=(20, 3))])
    return list(range(50)), questions, ids, vectors


# Few questions at once, so that there are several blocks of them.
BLOCKS = {"broadcast_bytes": 4000}
WAYS = ({}, BLOCKS, {"dim": True})


def _search(spark, data, k, dim=None, **options):
    """With ``dim``, by cells of vectors of so many numbers (True: as the last question)."""
    query_ids, questions, ids, vectors = data
    frame = _frame(spark, "id", ids, vectors)
    if dim:
        options["cells"] = fit_cells(frame, len(questions[-1]) if dim is True else dim)
    return nearest_passages(_frame(spark, "query_id", query_ids, questions), frame, k, **options)


@pytest.mark.parametrize("k", [1, 5, 250])
def test_scan_matches_brute_force(spark, grid, k):
    assert _rows(_search(spark, grid, k)) == sorted(brute_force(*grid, k))


@pytest.mark.parametrize("k", [1, 5, 250])
def test_cells_match_brute_force(spark, grid, k):
    assert _rows(_search(spark, grid, k, dim=3)) == sorted(brute_force(*grid, k))


def test_blocks_of_questions_match_brute_force(spark, grid):
    assert _rows(_search(spark, grid, 5, **BLOCKS)) == sorted(brute_force(*grid, 5))


def test_blocks_of_a_large_and_much_visited_cell(spark, grid, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK_BYTES", 12 * 40)
    monkeypatch.setattr(cells, "BLOCK_QUESTIONS", 7)
    assert _rows(_search(spark, grid, 5, dim=3)) == sorted(brute_force(*grid, 5))


def test_small_tiles(grid):
    """Tiles, the head and crowded bounds, without Spark."""
    query_ids, questions, ids, vectors = grid
    q, v = questions.astype(np.float32).astype(float), vectors
    for tile, head, crowded in ((7, 1, 0), (1 << 20, 1024, 4), (50, 64, 1)):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(nearest, "_TILE", tile)
            patch.setattr(nearest, "_HEAD", head)
            patch.setattr(nearest, "_CROWDED", crowded)
            patch.setattr(nearest, "_MEASURED", 11)
            blocks = [(pa.array(ids[i : i + 90]), v[i : i + 90]) for i in range(0, 600, 90)]
            found = nearest.best_of(pa.array(query_ids), q, blocks, 5, pa.string())
        rows = zip(*(found[c].to_pylist() for c in ("query_id", "id", "distance")))
        assert sorted(rows) == sorted(r[:3] for r in brute_force(*grid, 5))


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_blocks_match_brute_force(data):
    """Few coordinates and repeated rows, in blocks of any size, without Spark."""
    k = data.draw(st.integers(1, 6))
    draw = np.random.default_rng(data.draw(st.integers(0, 10**6)))
    n = data.draw(st.integers(1, 60))
    vectors = draw.integers(0, data.draw(st.integers(1, 5)), size=(n, 2)).astype(float)
    questions = draw.integers(0, 5, size=(4, 2)) + draw.choice([0.0, 0.25], size=(4, 1))
    ids = draw.permutation(n).tolist()
    step = data.draw(st.integers(1, 60))
    blocks = [(pa.array(ids[i : i + step]), vectors[i : i + step]) for i in range(0, n, step)]
    found = nearest.best_of(pa.array(range(4)), questions, blocks, k, pa.int64())
    rows = zip(*(found[c].to_pylist() for c in ("query_id", "id", "distance")))
    expected = brute_force(range(4), questions, ids, vectors, k)
    assert sorted(rows) == sorted(r[:3] for r in expected)


def test_hits_of_many_tasks_meet_in_two_steps(spark, grid, monkeypatch):
    monkeypatch.setattr(hits, "MERGES", 2)
    assert _rows(_search(spark, grid, 5)) == sorted(brute_force(*grid, 5))


def test_ranked_by_whole_distances(spark):
    """Differences beyond the sixth decimal decide, before the ids."""
    data = (["q"], [[0.0, 0.0]], ["z1", "z2", "b8", "a9"], [[1e-4, 0], [2e-4, 0], [5e-4, 0], [6e-4, 0]])
    for options in WAYS:
        assert [r[1] for r in _rows(_search(spark, data, 2, **options))] == ["z1", "z2"]


def test_any_order_of_questions_and_lengths(spark):
    """Each question finds the vectors of its own length, whichever comes first."""
    vectors = [[0.0, 0.0], [1.0, 1.0], [5.0], None]
    for questions in ([[1.0], [0.0, 0.0], [1.0, 1.0]], [[1.0, 1.0], [0.0, 0.0], [1.0]]):
        data = (list(range(3)), questions, list("abcd"), vectors)
        for options in ({}, BLOCKS, {"broadcast_bytes": 1}):
            found = {(r[0], r[1]) for r in _rows(_search(spark, data, 1, **options))}
            assert found == {(i, "c" if len(q) == 1 else "ab"[int(q[0])]) for i, q in enumerate(questions)}
    frame = _frame(spark, "id", list("abcd"), vectors)
    assert sorted(r["id"] for r in unsearchable(frame, 2).collect()) == ["c", "d"]


def test_fewer_vectors_than_k(spark):
    data = (["q"], [[0.0, 0.0]], [7, 8], [[1.0, 0.0], [0.0, 2.0]])
    for options in WAYS:
        assert _rows(_search(spark, data, 5, **options)) == [("q", 7, 1.0, 1), ("q", 8, 4.0, 2)]


def test_vectors_that_cannot_be_searched(spark):
    vectors = [None, [1.0], [1.0, 1.0], [], [3.0, 3.0]]
    questions = [None, [0.0, 0.0]]
    for options in WAYS:
        hits = _search(spark, ([1, 2], questions, list("abcde"), vectors), 5, **options)
        assert [(r[0], r[1]) for r in _rows(hits)] == [(2, "c"), (2, "e")]


def test_vectors_that_are_not_finite(spark):
    infinite, missing = float("inf"), float("nan")
    vectors = [[1.0, missing], [infinite, 0.0], [1.0, 1.0], [3.0, 3.0]]
    questions = [[0.0, 0.0], [missing, 0.0], [infinite, 0.0]]
    for options in WAYS:
        hits = _search(spark, ([1, 2, 3], questions, list("abcd"), vectors), 5, **options)
        assert [(r[0], r[1]) for r in _rows(hits)] == [(1, "c"), (1, "d")]


def test_questions_without_a_finite_vector(spark):
    data = ([1], [[float("nan"), 0.0]], ["a"], [[1.0, 1.0]])
    for options in WAYS:
        assert _rows(_search(spark, data, 5, **options)) == []


def test_small_distances_between_long_vectors(spark):
    draw = np.random.default_rng(4)
    vectors = 1e5 + draw.integers(0, 40, size=(300, 4)).astype(float)
    questions = vectors[:10] + 1
    data = (list(range(10)), questions, list(range(300)), vectors)
    for options in WAYS:
        assert _rows(_search(spark, data, 5, **options)) == sorted(brute_force(*data, 5))


def test_nothing_to_search(spark):
    some = _frame(spark, "query_id", [1], [[1.0]])
    none = _frame(spark, "id", [1], [None])
    assert nearest_passages(some, none, 3).count() == 0
    assert nearest_passages(some, none, 3, cells=fit_cells(none, 1)).count() == 0
    assert nearest_passages(
        none.withColumnRenamed("id", "query_id"), some.withColumnRenamed("query_id", "id"), 3
    ).count() == 0


def test_high_dimensions(spark):
    draw = np.random.default_rng(2)
    vectors, questions = draw.normal(size=(700, 48)), draw.normal(size=(25, 48))
    data = (list(range(25)), questions, list(range(700)), vectors)
    expected = sorted(brute_force(*data, 5))
    for options in WAYS:
        found = _rows(_search(spark, data, 5, **options))
        assert [(r[0], r[1], r[3]) for r in found] == [(r[0], r[1], r[3]) for r in expected]
        assert np.allclose([r[2] for r in found], [r[2] for r in expected], atol=2e-6)


def test_fitted_cells_serve_many_batches_and_approximate_search(spark):
    draw = np.random.default_rng(3)
    middles = draw.normal(size=(20, 8)) * 10
    vectors = np.repeat(middles, 40, axis=0) + draw.normal(size=(800, 8))
    questions = vectors[::40] + 0.01
    frame = _frame(spark, "id", list(range(800)), vectors)
    fitted = fit_cells(frame, 8, n_cells=20)
    assert fitted.sizes.sum() == 800
    data = (list(range(20)), questions, list(range(800)), vectors)
    asked = _frame(spark, "query_id", data[0], questions)
    expected = {r[:2] for r in brute_force(*data, 5)}
    exact = nearest_passages(asked, frame, 5, cells=fitted)
    assert {r[:2] for r in _rows(exact)} == expected
    first = search_cells(
        asked, fitted, 5, hit_schema(asked, frame), first_cells=1, complete=False
    )
    best = {(r["query_id"], r["id"]) for r in first.collect()}
    assert len(best & expected) >= 0.9 * len(expected)


def test_golden_retrieval(spark, golden, make_fake_model):
    _, parts, vectors = golden
    ids = [f"c_v_{i}" for i in range(4)]
    passages = spark.createDataFrame(
        list(zip(ids, parts, vectors)), "id string, content string, embedding array<float>"
    )
    questions = add_embedding(
        spark.createDataFrame([(1, parts[0])], "query_id int, content string"), make_fake_model
    )
    hits = nearest_passages(questions, passages, 2)
    rows = retrieved(hits, passages, FIELDS).orderBy("rank").collect()
    assert [r["id"] for r in rows] == ["c_v_0", "c_v_2"]
    (found,) = contexts(retrieved(hits, passages, FIELDS), FIELDS).collect()
    assert [tuple(c) for c in found["context"]] == [(ids[0], parts[0]), (ids[2], parts[2])]


def test_stored_cells_serve_another_session(spark, grid, tmp_path):
    query_ids, questions, ids, vectors = grid
    write_cells(fit_cells(_frame(spark, "id", ids, vectors), 3, n_cells=9), str(tmp_path))
    other = spark.newSession()
    fitted = read_cells(other, str(tmp_path))
    assert fitted.sizes.sum() == 600 and len(fitted.centers) == 9
    asked = _frame(other, "query_id", query_ids, questions)
    found = nearest_passages(asked, fitted.vectors, 5, cells=fitted)
    assert _rows(found) == sorted(brute_force(*grid, 5))


def test_too_many_cells_are_an_error(spark, grid):
    with pytest.raises(ValueError, match="a cell needs one"):
        fit_cells(_frame(spark, "id", ["a", "b"], [[0, 1], [1, 0]]), 2, n_cells=3)
    with pytest.raises(ValueError, match="n_cells"):
        fit_cells(_frame(spark, "id", grid[2], grid[3]), 3, n_cells=cells.MAX_CELLS + 1)


def test_hits_are_broadcast_if_few(spark, grid, monkeypatch):
    passages = spark.range(10).selectExpr("cast(id AS string) AS id", "'x' AS content")

    def plan():
        rows = retrieved(_search(spark, grid, 5), passages, FIELDS)
        text = rows._jdf.queryExecution().optimizedPlan().toString()
        return next(line for line in text.split("\n") if "Join Inner" in line)

    assert "strategy=broadcast" in plan()
    monkeypatch.setattr(context, "BROADCAST_HITS_BYTES", 5 * 50 * context.ROW_BYTES)
    assert "strategy=broadcast" not in plan()


def test_repeated_ids_are_one_passage(spark):
    rows = [
        ("x", "old", 1, [0.0, 0.0]),
        ("x", "new", 2, [0.1, 0.0]),
        ("y", "y", 1, [1.0, 0.0]),
        ("z", "z", 1, [2.0, 0.0]),
    ]
    passages = spark.createDataFrame(rows, "id string, content string, version int, embedding array<float>")
    asked = _frame(spark, "query_id", [1], [[0.0, 0.0]]).selectExpr("query_id", "'?' AS input", "embedding")
    for last_by in (["version"], None):
        (row,) = question_prompts(asked, passages, 2, fields=FIELDS, last_by=last_by).collect()
        first = "new" if last_by else "old"
        assert [c["content"] for c in row["context"]] == [first, "y"]
    assert last_of_repeated(passages.where("id != 'x'")).count() == 2


def test_last_of_repeated_ids_counts(spark):
    hits = spark.createDataFrame(
        [(1, "a", 0.0, 1), (1, "b", 1.0, 2)], "query_id int, id string, distance double, rank int"
    )
    passages = spark.createDataFrame(
        [("a", "old", 1), ("a", "new", 2), ("b", "only", 1)], "id string, content string, version int"
    )
    assert [tuple(r) for r in repeated_ids(passages).collect()] == [("a", 2)]
    rows = retrieved(hits, passages, FIELDS, last_by=["version"]).orderBy("rank").collect()
    assert [r["content"] for r in rows] == ["new", "only"]


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 1}, {"dim": 3}])
def test_model_embeds_questions_once(spark, grid, tmp_path, options):
    folder = str(tmp_path)

    def make():
        import tempfile

        def embed(texts):
            for text in texts:
                tempfile.mkstemp(prefix=f"{text}-", dir=folder)
            return [[float(t), 1.0, 2.0] for t in texts]

        return embed

    asked = spark.range(4, numPartitions=2).selectExpr("id AS query_id", "cast(id AS string) AS t")
    questions = add_embedding(asked, make, text="t")
    vectors = _frame(spark, "id", grid[2], grid[3])
    if "dim" in options:
        options = {"cells": fit_cells(vectors, options["dim"])}
    assert nearest_passages(questions, vectors, 3, **options).count() == 12
    assert len(list(tmp_path.iterdir())) == 4


def test_cells_hold_the_last_of_repeated_ids(spark):
    """A question beside the copy that does not count must not find its id there."""
    rows = [("x", 1, [0.0, 0.0], "old"), ("x", 2, [9.0, 9.0], "last"), ("y", 1, [1.0, 1.0], "other")]
    rows += [(f"far{i}", 1, [20.0 + i, 20.0], "far") for i in range(9)]
    rows += [("z", 1, [0.1, 0.0], "was searchable"), ("z", 2, None, "is not")]
    passages = spark.createDataFrame(rows, "id string, version int, embedding array<float>, content string")
    asked = spark.createDataFrame([(1, "?", [0.0, 0.0])], "query_id int, input string, embedding array<float>")
    options = {"k": 3, "fields": FIELDS, "last_by": ["version"]}
    scanned = question_prompts(asked, passages, **options).first()["context"]
    cells = fit_cells(passages, 2, 3, last_by=["version"])
    found = question_prompts(asked, passages, cells=cells, **options).first()["context"]
    assert [r["content"] for r in found] == ["other", "last", "far"] == [r["content"] for r in scanned]


def test_very_many_questions_are_joined(spark, grid, monkeypatch):
    """Beyond some scans no question reaches the driver, whatever lengths they have."""
    monkeypatch.setattr(search, "scan_nearest", None)
    query_ids, questions, ids, vectors = grid
    asked = [*questions.tolist(), [1.0, 2.0], None]
    found = [*vectors.tolist(), [0.0, 0.0], [float("nan")] * 3]
    frames = (
        _frame(spark, "query_id", [*query_ids, 98, 99], asked),
        _frame(spark, "id", [*ids, "short", "missing"], found),
    )
    wanted = sorted([*brute_force(*grid, 5), (98, "short", 5.0, 1)])
    assert _rows(nearest_passages(*frames, 5, broadcast_bytes=200)) == wanted


def test_cells_meet_in_groups_and_give_the_best_of_a_group(spark, grid, monkeypatch):
    query_ids, questions, ids, vectors = grid
    fitted = fit_cells(_frame(spark, "id", ids, vectors), len(questions[-1]), n_cells=8)
    monkeypatch.setattr(cells, "BLOCK_BYTES", 4 * len(questions[-1]) * (len(ids) // 3 + 1))
    asked = _frame(spark, "query_id", query_ids, questions)
    found = nearest_passages(asked, _frame(spark, "id", ids, vectors), 3, cells=fitted).collect()
    scan = nearest_passages(asked, _frame(spark, "id", ids, vectors), 3).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, scan))
    # A question is copied once per group, not once per cell, and has k hits of each at most.
    counts = {cell: len(query_ids) for cell in np.flatnonzero(fitted.sizes).tolist()}
    plan = cells._groups(counts, fitted.sizes, len(query_ids), len(ids) // 3 + 1)
    blocks = sum(salts for _, salts in {(group, salts) for _, group, salts, _ in plan})
    assert 1 < len({group for _, group, _, _ in plan}) < len(plan)
    schema = hit_schema(asked, fitted.vectors)
    visits = asked.select("query_id", "embedding", F.lit(float("inf")).alias("bound"))
    visits = cells.with_cells(visits, fitted, len(fitted.sizes), rest=False)
    met = cells._meet(visits, fitted, 3, schema)
    assert met.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 3 * blocks


def test_centres_are_fitted_on_a_bounded_number_of_vectors(spark, monkeypatch):
    monkeypatch.setattr(cells, "FIT_ROWS", 4)
    seen = []

    class Watched(cells.KMeans):
        def fit(self, rows):
            seen.append(rows.count())
            return super().fit(rows)

    monkeypatch.setattr(cells, "KMeans", Watched)
    vectors = np.random.default_rng(5).normal(size=(2000, 3)).astype(np.float32)
    fitted = fit_cells(_frame(spark, "id", range(2000), vectors), 3, n_cells=20)
    assert 20 <= seen[0] <= 160 and fitted.vectors.count() == fitted.sizes.sum() == 2000


def test_the_last_of_repeated_rows_keeps_the_order_of_columns(spark):
    rows = [("a", 1, "x", [1.0]), ("a", 2, "b", [2.0]), ("a", 2, "c", [0.0]), ("b", None, "y", None), (None, 1, "n", None)]
    frame = spark.createDataFrame(rows, "id string, version int, content string, embedding array<float>")
    last = last_of_repeated(frame.select("content", "id", "embedding", "version"), ["version"])
    assert last.columns == ["content", "id", "embedding", "version"]
    assert sorted(map(tuple, last.where("id is not null").collect())) == [("c", "a", [0.0], 2), ("y", "b", None, None)]
