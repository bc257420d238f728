"""Search by codes: of each vector a few bytes are read instead of its numbers.

Within a cell a vector is its centre and a residual. The residual's numbers are cut into
parts, and each part is replaced by the number of the nearest of 256 fitted ones, a byte. A
question's distances to the fitted parts are tables, from which the distance to any coded
vector is a sum of one entry per part. That distance is approximate; a multiple of k
candidates is therefore measured again by the vectors themselves.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passages.operators import nearest
from passages.operators.cells import Cells, in_blocks, read_cells, with_visits, write_cells
from passages.operators.context import marked_small
from passages.operators.embedding import valid_embeddings
from passages.operators.hits import hit_schema, ranked
from passages.sources.checkpoints import materialised

# A code is a byte.
CODES = 256
PARTS = 16
# Rounds of fitting, and the share of the error that a round must at least take off.
ROUNDS, LEAST_GAIN = 8, 0.01
# Candidates per result, first cells of a question, bytes of codes that meet in one task.
CANDIDATES, FIRST_CELLS = 20, 8
BLOCK_BYTES = 64 << 20
_TILE = 1 << 20
_STORED = "part int, code int, numbers array<double>"


@dataclass(frozen=True)
class Codes:
    """``rows(id, cell, code)`` of the vectors in ``cells``, and the fitted parts
    ``books[part, code]``."""

    rows: DataFrame
    cells: Cells
    books: np.ndarray


def _in_parts(residuals: np.ndarray, parts: int) -> np.ndarray:
    """``[part, row, number]``; the last part is filled up with zeros."""
    width = -(-residuals.shape[1] // parts)
    filled = np.zeros((len(residuals), parts * width))
    filled[:, : residuals.shape[1]] = residuals
    return filled.reshape(len(residuals), parts, width).transpose(1, 0, 2)


def _residuals(batch: pa.RecordBatch, centers: np.ndarray) -> np.ndarray:
    values = nearest.matrix(batch["embedding"], centers.shape[1])
    return values - centers[batch["cell"].to_numpy()]


def _nearest_codes(parts: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``[part, row]`` of the nearest fitted part, and the squared distance to it."""
    codes = np.empty(parts.shape[:2], np.uint8)
    errors = np.empty(parts.shape[:2])
    for part, book, code, error in zip(parts, books, codes, errors, strict=True):
        for tile in nearest.tiles(len(part), len(book)):
            squares = nearest.squared_distances(part[tile], book)
            code[tile], error[tile] = squares.argmin(axis=1), squares.min(axis=1)
    return codes, errors


def _first_books(cells: Cells, parts: int) -> np.ndarray:
    """The parts of the residuals of at most ``CODES`` vectors, those whose ids hash lowest."""
    rows = cells.vectors.orderBy(F.xxhash64("id")).limit(CODES).select("embedding", "cell").toArrow()
    found = _residuals(rows.combine_chunks().to_batches()[0], cells.centers)
    books = _in_parts(found, parts)
    # With fewer vectors than codes some are repeated; the first of equal ones is used.
    return books[:, np.arange(CODES) % books.shape[1]]


def _round(vectors: DataFrame, centers: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, float]:
    """Books of the means of all parts that had a code, and the error of the old ones."""
    shared = vectors.sparkSession.sparkContext.broadcast((centers, books))
    parts, width = books.shape[0], books.shape[2]
    numbers = [f"x{i}" for i in range(width)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, books = shared.value
        total = np.zeros((parts, CODES, width + 2))
        for batch in batches:
            rows = _in_parts(_residuals(batch, centers), parts)
            codes, errors = _nearest_codes(rows, books)
            for sums, own, code, error in zip(total, rows, codes, errors, strict=True):
                sums[:, 0] += np.bincount(code, minlength=CODES)
                sums[:, 1] += np.bincount(code, error, minlength=CODES)
                for i in range(width):
                    sums[:, 2 + i] += np.bincount(code, own[:, i], minlength=CODES)
        part, code = np.divmod(np.arange(parts * CODES), CODES)
        columns = [pa.array(part), pa.array(code), *map(pa.array, total.reshape(-1, width + 2).T)]
        yield pa.RecordBatch.from_arrays(columns, ["part", "code", "n", "error", *numbers])

    fields = ", ".join(f"{name} double" for name in ("n", "error", *numbers))
    found = (
        vectors.select("embedding", "cell")
        .mapInArrow(sums, f"part long, code long, {fields}")
        .groupBy("part", "code")
        .agg(*[F.sum(name).alias(name) for name in ("n", "error", *numbers)])
        .orderBy("part", "code")
        .toArrow()  # a row per part and code
    )
    table = np.stack([found[c].to_numpy() for c in ("n", "error", *numbers)], axis=1)
    table = table.reshape(parts, CODES, width + 2)
    used = table[:, :, :1] > 0
    means = table[:, :, 2:] / np.maximum(table[:, :, :1], 1)
    return np.where(used, means, books), float(table[:, :, 1].sum())


def fit_codes(cells: Cells, parts: int = PARTS, rounds: int = ROUNDS) -> Codes:
    """Fit the parts on the residuals of all vectors of ``cells``, and code every vector.

    Each round is a pass over the vectors that returns sums, a row per part and code;
    fitting ends after ``rounds``, or once a round takes less than ``LEAST_GAIN`` off the
    error. A vector then has ``parts`` bytes.
    """
    dim = cells.centers.shape[1]
    if not 1 <= parts <= dim:
        raise ValueError(f"parts must be between 1 and the {dim} numbers of a vector")
    width = -(-dim // parts)
    books = np.zeros((parts, CODES, width))
    if cells.sizes.sum():
        books = _first_books(cells, parts)
        before = np.inf
        for _ in range(rounds):
            better, error = _round(cells.vectors, cells.centers, books)
            if error > (1 - LEAST_GAIN) * before:
                break
            books, before = better, error
    shared = cells.vectors.sparkSession.sparkContext.broadcast((cells.centers, books))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, books = shared.value
        for batch in batches:
            codes, _ = _nearest_codes(_in_parts(_residuals(batch, centers), parts), books)
            flat = pa.py_buffer(np.ascontiguousarray(codes.T))
            offsets = pa.py_buffer(np.arange(0, (len(batch) + 1) * parts, parts, np.int32))
            code = pa.Array.from_buffers(pa.binary(), len(batch), [None, offsets, flat])
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["cell"], code], ["id", "cell", "code"]
            )

    id_type = cells.vectors.schema["id"].dataType.simpleString()
    rows = cells.vectors.select("id", "embedding", "cell").mapInArrow(
        encode, f"id {id_type}, cell int, code binary"
    )
    return Codes(materialised(rows), cells, books)


def _by_cell(rows: DataFrame) -> DataFrame:
    """In order of the cell, a large one in several files, so that readers can skip files
    and row groups of other cells."""
    wanted = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartitionByRange(wanted, "cell", F.xxhash64("id")).sortWithinPartitions("cell")


def write_codes(codes: Codes, path: str) -> None:
    """The cells to ``path``, with vectors in order of their cells, codes and books beside."""
    ordered = Cells(_by_cell(codes.cells.vectors), codes.cells.centers, codes.cells.sizes, codes.cells.radii)
    write_cells(ordered, path)
    _by_cell(codes.rows).write.mode("overwrite").parquet(f"{path}/codes")
    books = [
        (part, code, [float(x) for x in numbers])
        for part, book in enumerate(codes.books)
        for code, numbers in enumerate(book)
    ]
    session = codes.rows.sparkSession
    session.createDataFrame(books, _STORED).coalesce(1).write.mode("overwrite").parquet(f"{path}/books")


def read_codes(session: SparkSession, path: str) -> Codes:
    # A row per part and code.
    rows = session.read.schema(_STORED).parquet(f"{path}/books").orderBy("part", "code").collect()
    books = np.array([row["numbers"] for row in rows])
    return Codes(
        session.read.parquet(f"{path}/codes"),
        read_cells(session, path),
        books.reshape(-1, CODES, books.shape[1]),
    )


def _in_buckets(rows: DataFrame, buckets: np.ndarray) -> DataFrame:
    """``rows`` with their cell as ``own``, and the bucket of it in its place."""
    plan = [(cell, bucket) for cell, bucket in enumerate(buckets.tolist())]
    plan = F.broadcast(rows.sparkSession.createDataFrame(plan, "own int, cell int"))
    return rows.withColumnRenamed("cell", "own").join(plan, "own")


class _Nearest:
    """The ``count`` least of each question's distances, of which parts come one by one."""

    def __init__(self, questions: int, count: int):
        self.count = count
        self.cut = np.full(questions, np.inf)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, question: np.ndarray, column: np.ndarray, distances: np.ndarray) -> None:
        """``distances`` of the questions, in rows, to the columns."""
        last = self.cut[question]
        if distances.shape[1] > self.count:
            own = np.partition(distances, self.count - 1, axis=1)[:, self.count - 1]
            last = np.minimum(last, own)
        row, place = np.nonzero(distances <= last[:, None])
        self.parts.append((question[row], column[place], distances[row, place]))
        self.held += len(row)
        if self.held > _TILE:
            self.result()

    def result(self) -> tuple[np.ndarray, ...]:
        """Questions, columns and distances; of equal distances the first columns are kept."""
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        question, column, distance = (np.concatenate(part) for part in zip(*self.parts, strict=True))
        order = np.lexsort((column, distance, question))
        order = order[nearest.leading(question[order], self.count)]
        question, column, distance = question[order], column[order], distance[order]
        full = np.bincount(question, minlength=len(self.cut)) >= self.count
        worst = np.zeros(len(self.cut))
        np.maximum.at(worst, question, distance)
        self.cut = np.where(full, worst, self.cut)
        self.parts, self.held = [(question, column, distance)], len(question)
        return question, column, distance


def _candidates(visits: DataFrame, codes: Codes, count: int, schema) -> DataFrame:
    """The ``count`` codes of each block that lie nearest to each of its questions.

    A block holds the codes of many small cells, or a part of a large one's, so that what a
    question gets back does not grow with the cells it visits.
    """
    centers, books, sizes = codes.cells.centers, codes.books, codes.cells.sizes
    parts = len(books)
    block_rows = max(1, BLOCK_BYTES // (4 * parts))
    buckets = (np.cumsum(sizes) - sizes) // block_rows
    shared = visits.sparkSession.sparkContext.broadcast((centers, books))
    left, right = in_blocks(
        _in_buckets(visits, buckets),
        _in_buckets(codes.rows, buckets),
        np.bincount(buckets, sizes).astype(np.int64),
        block_rows,
    )

    def score(asked: pa.Table, found: pa.Table) -> pa.Table:
        centers, books = shared.value
        found = found.sort_by("id")  # equal codes count in order of the id
        code = np.frombuffer(b"".join(found["code"].to_pylist()), np.uint8).reshape(-1, parts)
        cell_of, visited = found["own"].to_numpy(), asked["own"].to_numpy()
        wanted = nearest.matrix(asked["embedding"], centers.shape[1]) - centers[visited]
        named = asked["query_id"].combine_chunks().dictionary_encode()
        question = named.indices.to_numpy()
        best = _Nearest(len(named.dictionary), count)
        for cell in np.intersect1d(visited, cell_of).tolist():
            column, rows = np.flatnonzero(cell_of == cell), np.flatnonzero(visited == cell)
            own = code[column].T
            step = max(1, _TILE // max(len(column), CODES))
            for some in np.split(rows, range(step, len(rows), step)):
                total = np.zeros((len(some), len(column)))
                for part, book, which in zip(_in_parts(wanted[some], parts), books, own, strict=True):
                    total += nearest.squared_distances(part, book)[:, which]
                best.add(question[some], column, total)
        question, column, distance = best.result()
        return pa.table(
            [
                named.dictionary.take(pa.array(question)),
                found["id"].combine_chunks().take(pa.array(column)),
                pa.array(distance),
                pa.array(cell_of[column], pa.int32()),
            ],
            ["query_id", "id", "distance", "cell"],
        )

    keys = ["cell", "salt", "slice"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    return (
        left.drop("bound").groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, f"{fields}, cell int")
    )


def search_codes(
    questions: DataFrame,
    codes: Codes,
    k: int = 5,
    first_cells: int = FIRST_CELLS,
    candidates: int = CANDIDATES,
) -> DataFrame:
    """``query_id, id, distance, rank`` of the k nearest of the vectors that codes suggest.

    A question visits its ``first_cells`` nearest cells and takes the ``candidates * k``
    vectors there whose codes are nearest; their vectors give the true distances, by which
    the k best are ranked. Distances are exact, the choice is approximate. Codes and
    vectors are read of the visited cells only, and vectors meet candidates, not questions.
    """
    dim = codes.cells.centers.shape[1]
    schema = hit_schema(questions, codes.cells.vectors)
    asked = materialised(
        valid_embeddings(questions.select("query_id", "embedding"), dim).where(
            F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
        )
    )
    unbounded = asked.withColumn("bound", F.lit(float("inf")))
    visits = materialised(with_visits(unbounded, codes.cells, first_cells, rest=False))
    # At most MAX_CELLS numbers.
    visited = [row["cell"] for row in visits.select("cell").distinct().collect()]
    of_visited = Codes(codes.rows.where(F.col("cell").isin(visited)), codes.cells, codes.books)
    near = ranked(_candidates(visits, of_visited, candidates * k, schema), candidates * k)
    near = marked_small(near.select("query_id", "id", "cell"))
    vectors = codes.cells.vectors.where(F.col("cell").isin(visited))
    pairs = vectors.join(near, ["cell", "id"]).join(
        asked.withColumnRenamed("embedding", "asked"), "query_id"
    )

    @F.arrow_udf("double")
    def measured(asked: pa.Array, embedding: pa.Array) -> pa.Array:
        return pa.array(nearest.distances(nearest.matrix(asked, dim), nearest.matrix(embedding, dim)))

    distance = measured.asNondeterministic()("asked", "embedding").alias("distance")
    return ranked(pairs.select("query_id", "id", distance), k)
