"""Scoring of one block of vectors against one block of questions.

Squared L2 distances; equal distances are ordered by id. Only the best k per question
leave a block, never the scored pairs. A matrix product finds the candidates and the
differences of the vectors give their distances, summed in the order of the dimensions.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Error of a distance by the product, as a share of the squares it is made of.
PRODUCT_ERROR = 1e-13
# Distances held at once, rows that are scored first, candidates measured at once.
_TILE = 1 << 20
_HEAD = 1024
_MEASURED = 1 << 15
# Vectors of a block that are scored at once.
CHUNK_ROWS = 1 << 14
# Candidates per question, as a multiple of k, from which bounds count as loose.
_CROWDED = 4

_ORDER = [("query", "ascending"), ("distance", "ascending"), ("id", "ascending")]


def matrix(vectors: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Valid vectors of an Arrow list column as rows of float64."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, dim)


def of_length(vectors: pa.Array, dim: int) -> np.ndarray:
    """Mask of the vectors of ``dim`` finite numbers in an Arrow list column."""
    right = pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False)
    mask = np.array(right.to_numpy(zero_copy_only=False))
    mask[mask] = finite(matrix(vectors.filter(right), dim))
    return mask


def finite(vectors: np.ndarray) -> np.ndarray:
    """Mask of the rows without a missing or infinite number."""
    return np.isfinite(vectors).all(axis=1)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d, 0.0)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of row to row; the same for the same rows, wherever they meet."""
    total = np.zeros(len(a))
    for dimension in (a - b).T:
        total += dimension * dimension
    return total


def tiles(rows: int, columns: int) -> Iterator[slice]:
    """Slices of rows whose product with the columns is held at once."""
    step = max(1, _TILE // max(columns, 1))
    return (slice(start, start + step) for start in range(0, rows, step))


def leading(group: np.ndarray, k: int) -> np.ndarray:
    """Mask of the first k rows of each run of equal values."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.array([], int)
    lengths = np.diff(np.r_[first, len(group)])
    return np.arange(len(group)) - np.repeat(first, lengths) < k


def _copies_beyond(vectors: np.ndarray, k: int) -> np.ndarray:
    """Rows left when of equal vectors only the first k are kept."""
    rows = np.ascontiguousarray(vectors)
    rows = rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel()
    distinct, group = np.unique(rows, return_inverse=True)
    if len(distinct) == len(rows):
        return np.arange(len(rows))
    order = np.argsort(group, kind="stable")
    return np.sort(order[leading(group[order], k)])


class Best:
    """The k best vectors seen so far for each question of a block."""

    def __init__(self, questions: np.ndarray, k: int, id_type: pa.DataType, bounds=None):
        self.k = k
        self.questions = questions
        # One product gives the distances less the question's own square.
        self.factors = np.hstack([-2.0 * questions, np.ones((len(questions), 1))])
        self.squares = (questions * questions).sum(axis=1)
        # Distances above a question's bound cannot be among its k best.
        self.bounds = np.full(len(questions), np.inf) if bounds is None else bounds.copy()
        self.found = pa.table(
            {
                "query": pa.array([], pa.int64()),
                "distance": pa.array([], pa.float64()),
                "id": pa.array([], id_type),
            }
        )

    def add(self, ids: pa.Array, vectors: np.ndarray, asked: np.ndarray | None = None) -> None:
        """Score ``vectors`` for all questions, or for those at the places ``asked``."""
        usable = finite(vectors)
        if not usable.all():
            ids, vectors = ids.filter(pa.array(usable)), vectors[usable]
        asked = np.arange(len(self.questions)) if asked is None else asked
        if not len(vectors) or not len(asked):
            return
        # In order of id, so that among equal distances the first columns are kept.
        order = pc.sort_indices(ids).to_numpy()
        kept = _copies_beyond(vectors[order], self.k)
        order = order[kept]
        ids, vectors = ids.take(pa.array(order)), vectors[order]
        # A few rows first: they bound the distances that the others must beat.
        head = max(_HEAD, self.k) if np.isinf(self.bounds[asked]).any() else 0
        for part in (slice(0, head), slice(head, None)):
            if len(vectors[part]):
                self._score(ids[part], vectors[part], asked)

    def _score(self, ids: pa.Array, vectors: np.ndarray, asked: np.ndarray) -> None:
        squares = (vectors * vectors).sum(axis=1, keepdims=True)
        factors = np.hstack([vectors, squares]).T
        rows, columns, measured = [], [], []
        for places in tiles(len(asked), len(vectors)):
            tile = asked[places]
            d = self.factors[tile] @ factors
            square = self.squares[tile]
            slack = PRODUCT_ERROR * (square + squares.max())
            cut = self.bounds[tile] - square + slack
            near = np.flatnonzero(d <= cut[:, None])
            if len(near) > _CROWDED * self.k * len(d) and d.shape[1] > self.k:
                # The bounds are loose here; those within this block may be closer.
                kth = np.partition(d, self.k - 1, axis=1)[:, self.k - 1]
                near = np.flatnonzero(d <= np.minimum(cut, kth + 2 * slack)[:, None])
            row, column = np.divmod(near, d.shape[1])
            row = tile[row]
            value = self._measure(row, vectors, column)
            best = np.lexsort((column, value, row))
            best = best[leading(row[best], self.k)]
            rows.append(row[best])
            columns.append(column[best])
            measured.append(value[best])
        columns = np.concatenate(columns)
        if len(columns):
            fresh = pa.table(
                {
                    "query": pa.array(np.concatenate(rows), pa.int64()),
                    "distance": pa.array(np.concatenate(measured), pa.float64()),
                    "id": ids.take(pa.array(columns)),
                }
            )
            self._merge(fresh)

    def _measure(self, row: np.ndarray, vectors: np.ndarray, column: np.ndarray) -> np.ndarray:
        measured = np.empty(len(row))
        for i in range(0, len(row), _MEASURED):
            part = slice(i, i + _MEASURED)
            measured[part] = distances(self.questions[row[part]], vectors[column[part]])
        return measured

    def _merge(self, fresh: pa.Table) -> None:
        merged = pa.concat_tables([self.found, fresh]).sort_by(_ORDER)
        merged = merged.filter(pa.array(leading(merged["query"].to_numpy(), self.k)))
        query, distance = merged["query"].to_numpy(), merged["distance"].to_numpy()
        full = np.bincount(query, minlength=len(self.questions)) >= self.k
        worst = np.zeros(len(self.questions))
        np.maximum.at(worst, query, distance)
        self.bounds = np.where(full, np.minimum(self.bounds, worst), self.bounds)
        self.found = merged

    def result(self, query_ids: pa.Array) -> pa.Table:
        found = self.found
        return pa.table(
            {
                "query_id": query_ids.take(found["query"].combine_chunks()),
                "id": found["id"],
                "distance": found["distance"],
            }
        )


def best_of(
    query_ids: pa.Array,
    questions: np.ndarray,
    blocks: Iterable[tuple[pa.Array, np.ndarray]],
    k: int,
    id_type: pa.DataType,
    bounds: np.ndarray | None = None,
) -> pa.Table:
    best = Best(questions, k, id_type, bounds)
    for ids, vectors in blocks:
        best.add(ids, vectors)
    return best.result(query_ids)
