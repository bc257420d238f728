"""Search by cells: vectors grouped around centres, questions sent to few groups.

Each vector belongs to the cell of its nearest centre. A question first visits the
cells nearest to it, which bounds the distance of its k-th neighbour; it then visits
every other cell that may hold a nearer vector. By the triangle inequality a cell
cannot if the distance to its centre, less the cell's radius, exceeds the bound. So
the result is exact, and the number of cells visited first only sets the cost.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from passages.operators import nearest
from passages.operators.context import last_of_repeated
from passages.operators.embedding import valid_embeddings
from passages.operators.hits import ranked
from passages.sources.checkpoints import materialised, stored

MAX_CELLS = 4096
# Vectors per cell that centres are fitted on, at most; every vector is assigned to a cell.
FIT_ROWS = 128
_STORED = "cell int, center array<double>, size long, radius double"
# The centres go to every task.
CENTER_BYTES = 32 << 20
# Bytes of vectors, and rows of questions, that meet in one task.
BLOCK_BYTES = 64 << 20
BLOCK_QUESTIONS = 8192
# Slack, as a share of the lengths of the vectors that distances are taken between, for
# the square roots of products.
_ROOT_ERROR = 2 * nearest.PRODUCT_ERROR**0.5


@dataclass(frozen=True)
class Cells:
    """Vectors ``id, embedding, cell`` with the centres and the extent of the cells."""

    vectors: DataFrame
    centers: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray


def _fit_centers(vectors: DataFrame, n_rows: int, dim: int, n_cells: int, seed: int) -> np.ndarray:
    """Centres by k-means on about ``FIT_ROWS`` vectors a cell, those with the lowest hashes."""
    if n_rows > FIT_ROWS * n_cells:
        share = int(FIT_ROWS * n_cells / n_rows * (1 << 32))
        vectors = vectors.where(F.pmod(F.xxhash64("id", "embedding", F.lit(seed)), F.lit(1 << 32)) < share)
    model = KMeans(k=n_cells, maxIter=5, initMode="random", seed=seed).fit(
        vectors.select(array_to_vector("embedding").alias("features"))
    )
    return np.array(model.clusterCenters())


def _assign(vectors: DataFrame, centers: np.ndarray) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(centers)

    @F.arrow_udf("struct<cell:int,reach:double>")
    def nearest_center(embedding: pa.Array) -> pa.Array:
        centers = shared.value
        values = nearest.matrix(embedding, centers.shape[1])
        cell, reach = np.zeros(len(values), np.int32), np.zeros(len(values))
        # One product gives the distances less the vector's own square.
        factors = np.vstack([-2.0 * centers.T, (centers * centers).sum(axis=1)])
        for tile in nearest.tiles(len(values), len(centers)):
            part = values[tile]
            distances = np.hstack([part, np.ones((len(part), 1))]) @ factors
            cell[tile] = distances.argmin(axis=1)
            least = np.take_along_axis(distances, cell[tile][:, None].astype(np.int64), axis=1)[:, 0]
            reach[tile] = np.sqrt(np.maximum(least + (part * part).sum(axis=1), 0.0))
        unusable = ~nearest.finite(values)
        return pa.StructArray.from_arrays(
            [pa.array(cell, pa.int32(), mask=unusable), pa.array(reach, pa.float64())],
            ["cell", "reach"],
        )

    near = nearest_center.asNondeterministic()("embedding")
    return (
        vectors.withColumn("__near", near)
        .select("id", "embedding", "__near.cell", "__near.reach")
        .where("cell is not null")
    )


def fit_cells(
    vectors: DataFrame,
    dim: int,
    n_cells: int | None = None,
    seed: int = 0,
    last_by: list[str] | None = None,
) -> Cells:
    """Fit centres, on at most ``FIT_ROWS`` vectors a cell, assign every vector and measure the cells.

    ``vectors(id, embedding)``; only vectors of ``dim`` finite numbers are in cells. They
    are computed once and kept, and so are the assigned ones; fitted cells serve any
    number of batches of questions and can be written (``write_cells``). Without
    ``n_cells`` there are as many as the square root of the number of vectors, within
    ``MAX_CELLS`` and what ``CENTER_BYTES`` hold; more cells than vectors are an error.

    Of rows that repeat an id the last by ``last_by``, then by the other columns, counts,
    as in a search without cells: the others are in no cell, whether it can be searched or not.
    """
    most = min(MAX_CELLS, CENTER_BYTES // (8 * dim))
    if n_cells is not None and not 1 <= n_cells <= most:
        raise ValueError(f"n_cells must be between 1 and {most} at {dim} dimensions")
    vectors = last_of_repeated(stored(vectors), last_by)
    vectors = stored(
        valid_embeddings(vectors.select("id", "embedding"), dim).where(
            F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
        )
    )
    n_rows = vectors.count()
    if n_cells is None:
        n_cells = min(int(np.sqrt(n_rows)), most)
    elif n_cells > max(n_rows, 1):
        raise ValueError(f"{n_cells} cells of {n_rows} vectors: a cell needs one at least")
    # Any centre serves a single cell, and k-means wants two at least.
    centers = np.zeros((1, dim))
    if n_cells > 1:
        centers = _fit_centers(vectors, n_rows, dim, n_cells, seed)
    assigned = stored(_assign(vectors, centers))
    sizes, radii = np.zeros(len(centers), np.int64), np.zeros(len(centers))
    # One row per cell, at most MAX_CELLS.
    extent = assigned.groupBy("cell").agg(F.count("*").alias("n"), F.max("reach").alias("r"))
    for row in extent.collect():
        sizes[row["cell"]], radii[row["cell"]] = row["n"], row["r"]
    return Cells(assigned.select("id", "embedding", "cell"), centers, sizes, radii)


def write_cells(cells: Cells, path: str) -> None:
    """Centres and extents to ``path/cells``, the assigned vectors to ``path/vectors``."""
    session = cells.vectors.sparkSession
    rows = [
        (n, [float(x) for x in center], int(size), float(radius))
        for n, (center, size, radius) in enumerate(
            zip(cells.centers, cells.sizes, cells.radii, strict=True)
        )
    ]
    session.createDataFrame(rows, _STORED).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    cells.vectors.write.mode("overwrite").parquet(f"{path}/vectors")


def read_cells(session: SparkSession, path: str) -> Cells:
    """Cells as ``write_cells`` left them, in this session or another."""
    # One row per cell, at most MAX_CELLS.
    rows = session.read.schema(_STORED).parquet(f"{path}/cells").orderBy("cell").collect()
    return Cells(
        session.read.parquet(f"{path}/vectors"),
        np.array([row["center"] for row in rows]),
        np.array([row["size"] for row in rows], np.int64),
        np.array([row["radius"] for row in rows]),
    )


def _wanted(questions: np.ndarray, bounds: np.ndarray, extent, first: int, rest: bool):
    """For each question the cells to visit, as counts and their numbers in a row."""
    centers, sizes, radii = extent
    distances = np.sqrt(nearest.squared_distances(questions, centers))
    distances[:, sizes == 0] = np.inf
    order = np.argsort(distances, axis=1, kind="stable")
    usable = np.isfinite(np.take_along_axis(distances, order, axis=1))
    if rest:
        lengths = np.linalg.norm(questions, axis=1) + radii.max()
        lengths += 2 * np.linalg.norm(centers, axis=1).max()
        gap = np.maximum(distances - radii - _ROOT_ERROR * lengths[:, None], 0.0)
        wanted = np.take_along_axis(gap**2 <= bounds[:, None], order, axis=1)
        wanted[:, :first] = False
    else:
        wanted = np.zeros(order.shape, bool)
        wanted[:, :first] = True
    wanted &= usable
    return wanted.sum(axis=1), order[wanted]


def with_cells(questions: DataFrame, cells: Cells, first: int, rest: bool) -> DataFrame:
    """The questions with the array ``cells`` of those to visit.

    ``rest`` asks for the cells that are not among the ``first`` nearest ones and
    that the bound does not rule out.
    """
    shared = questions.sparkSession.sparkContext.broadcast(
        (cells.centers, cells.sizes, cells.radii)
    )

    @F.arrow_udf("array<int>")
    def to_visit(embedding: pa.Array, bound: pa.Array) -> pa.Array:
        centers = shared.value[0]
        asked = nearest.matrix(embedding, centers.shape[1])
        bounds = bound.to_numpy(zero_copy_only=False)
        counts, numbers = [np.zeros(1, np.int64)], [np.zeros(0, np.int64)]
        for tile in nearest.tiles(len(asked), len(centers)):
            n, cell = _wanted(asked[tile], bounds[tile], shared.value, first, rest)
            counts.append(n)
            numbers.append(cell)
        return pa.ListArray.from_arrays(
            pa.array(np.cumsum(np.concatenate(counts)), pa.int32()),
            pa.array(np.concatenate(numbers), pa.int32()),
        )

    visits = to_visit.asNondeterministic()("embedding", "bound").alias("cells")
    return questions.select("query_id", "embedding", "bound", visits)


def with_visits(questions: DataFrame, cells: Cells, first: int, rest: bool) -> DataFrame:
    """One row per question and cell to visit (see ``with_cells``), with the bound found so far."""
    visits = with_cells(questions, cells, first, rest)
    return visits.select("query_id", "embedding", "bound", F.explode_outer("cells").alias("cell")).where(
        "cell is not null"
    )


def in_blocks(
    visits: DataFrame, rows: DataFrame, sizes: np.ndarray, block_rows: int
) -> tuple[DataFrame, DataFrame]:
    """``visits`` and ``rows``, which have a ``cell``, with ``slice`` and ``salt`` of the blocks
    in which they meet.

    A large cell is cut into ``salts`` blocks of rows and a much visited one into
    ``slices`` of questions, so that no pair of blocks outgrows a task.
    """
    # One row per cell, at most MAX_CELLS.
    visited = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}
    plan = visits.sparkSession.createDataFrame(
        [
            (cell, int(-(-int(sizes[cell]) // block_rows)), -(-n // BLOCK_QUESTIONS))
            for cell, n in visited.items()
        ],
        "cell int, salts int, slices int",
    )
    plan = F.broadcast(plan)

    def span(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    # Any salt is right, as a question goes to all salts of a cell. The partition is
    # hashed too, so that copies under one id are spread as well.
    salt = F.pmod(F.xxhash64("id", F.spark_partition_id()), F.col("salts")).cast("int")
    slice_ = F.pmod(F.xxhash64("query_id"), F.col("slices")).cast("int")
    left = (
        visits.join(plan, "cell")
        .withColumn("slice", slice_)
        .withColumn("salt", span("salts"))
        .drop("salts", "slices")
    )
    right = (
        rows.join(plan, "cell")
        .withColumn("salt", salt)
        .withColumn("slice", span("slices"))
        .drop("salts", "slices")
    )
    return left, right


def _groups(visited: dict[int, int], sizes: np.ndarray, n_questions: int, block_rows: int):
    """``cell, group, salts, slices`` of the visited cells.

    Cells go together into groups of at most ``block_rows`` vectors, so that a question is copied
    once for all of them. A larger cell is a group, cut into ``salts`` blocks of its
    vectors; a group that many questions visit is cut into ``slices`` of them.
    """
    plan, group, held, asked = [], -1, block_rows, []
    for cell in sorted(visited):
        if held + int(sizes[cell]) > block_rows:
            group, held = group + 1, 0
            asked.append(0)
        held += int(sizes[cell])
        asked[group] = min(n_questions, asked[group] + visited[cell])
        plan.append((cell, group, -(-int(sizes[cell]) // block_rows)))
    return [(cell, group, salts, -(-asked[group] // BLOCK_QUESTIONS)) for cell, group, salts in plan]


def _meet(visits: DataFrame, cells: Cells, k: int, schema: StructType) -> DataFrame:
    """The k best hits per question and block of a group of cells."""
    dim = cells.centers.shape[1]
    visits = stored(visits)
    # One row per cell, at most MAX_CELLS.
    visited = visits.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect()
    plan = _groups(
        {r["cell"]: r["count"] for r in visited}, cells.sizes, visits.count(), max(1, BLOCK_BYTES // (4 * dim))
    )
    session = visits.sparkSession
    group_of = np.full(len(cells.sizes), -1)
    for cell, group, _, _ in plan:
        group_of[cell] = group
    shared = session.sparkContext.broadcast(group_of)

    @F.arrow_udf("array<struct<group:int,cells:array<int>>>")
    def by_group(visited: pa.Array) -> pa.Array:
        numbers = visited.flatten().to_numpy(zero_copy_only=False)
        lengths = visited.value_lengths().fill_null(0).to_numpy()
        row, group = np.repeat(np.arange(len(visited)), lengths), shared.value[numbers]
        order = np.lexsort((numbers, group, row))
        row, group, numbers = row[order], group[order], numbers[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (group[1:] != group[:-1])
        first = np.flatnonzero(new)
        lists = pa.ListArray.from_arrays(
            pa.array(np.r_[first, len(row)], pa.int32()), pa.array(numbers, pa.int32())
        )
        parts = pa.StructArray.from_arrays(
            [pa.array(group[first], pa.int32()), lists], ["group", "cells"]
        )
        ends = np.r_[0, np.cumsum(np.bincount(row[first], minlength=len(visited)))]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)

    # Any salt is right, as a question goes to all salts of a group. The partition is
    # hashed too, so that copies under one id are spread as well.
    salt = F.pmod(F.xxhash64("id", F.spark_partition_id()), F.col("salts")).cast("int")
    slice_ = F.pmod(F.xxhash64("query_id"), F.col("slices")).cast("int")
    by_cell = session.createDataFrame(plan, "cell int, group int, salts int, slices int")
    groups = by_cell.select("group", "salts", "slices").distinct()

    def span(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = (
        visits.select("query_id", "embedding", "bound", F.explode(by_group.asNondeterministic()("cells")).alias("part"))
        .select("query_id", "embedding", "bound", "part.*")
        .join(F.broadcast(groups), "group")
        .withColumn("slice", slice_)
        .withColumn("salt", span("salts"))
        .drop("salts", "slices")
    )
    right = (
        cells.vectors.join(F.broadcast(by_cell), "cell")
        .withColumn("salt", salt)
        .withColumn("slice", span("slices"))
        .drop("salts", "slices")
    )

    def score(questions: pa.Table, vectors: pa.Table) -> pa.Table:
        asked = nearest.matrix(questions["embedding"], dim)
        bounds = questions["bound"].to_numpy()
        best = nearest.Best(asked, k, vectors.schema.field("id").type, bounds)
        wanted = questions["cells"].combine_chunks()
        if vectors.num_rows and len(asked):
            place = np.repeat(np.arange(len(asked)), wanted.value_lengths().to_numpy())
            number = wanted.flatten().to_numpy()
            order = np.argsort(number, kind="stable")
            place, number = place[order], number[order]
            vectors = vectors.sort_by("cell")
            cell = vectors["cell"].to_numpy()
            for start in np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]).tolist():
                low, high = np.searchsorted(number, [cell[start], cell[start] + 1])
                own = vectors.slice(start, int(np.searchsorted(cell, cell[start] + 1)) - start)
                for at in range(0, own.num_rows, nearest.CHUNK_ROWS):
                    part = own.slice(at, nearest.CHUNK_ROWS).combine_chunks()
                    best.add(
                        part["id"].combine_chunks(), nearest.matrix(part["embedding"], dim), place[low:high]
                    )
        return best.result(questions["query_id"].combine_chunks())

    keys = ["group", "salt", "slice"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, schema)


def search_cells(
    questions: DataFrame,
    cells: Cells,
    k: int,
    schema: StructType,
    first_cells: int = 4,
    complete: bool = True,
) -> DataFrame:
    """Hits ``query_id, id, distance`` that hold the k nearest of each question.

    ``complete=False`` stops after the first cells: cheaper, and approximate.
    """
    unbounded = questions.select("query_id", "embedding", F.lit(float("inf")).alias("bound"))
    hits = _meet(with_cells(unbounded, cells, first_cells, rest=False), cells, k, schema)
    if not complete:
        return hits
    hits = materialised(ranked(hits, k))
    # The k-th distance so far; a question with fewer than k hits has no bound yet.
    bounds = hits.where(F.col("rank") == k).select("query_id", F.col("distance").alias("kth"))
    bounded = questions.join(bounds, "query_id", "left").select(
        "query_id", "embedding", F.coalesce("kth", F.lit(float("inf"))).alias("bound")
    )
    more = _meet(with_cells(bounded, cells, first_cells, rest=True), cells, k, schema)
    return hits.drop("rank").unionByName(more)
