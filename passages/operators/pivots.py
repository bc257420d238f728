"""Nearest neighbours of a whole table of questions, as a join of blocks.

Pivots, a bounded sample of the vectors, cut the questions into cells. The pivots are
vectors themselves, so the distance of a question to its k-th nearest pivot bounds that of
its k-th neighbour; with the question's distance to the pivot of its cell it gives how far
from that pivot a neighbour may lie. The vectors are read once: each goes to the blocks of
the cells that it lies within reach of, and to no other.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.operators import nearest
from passages.operators.embedding import valid_embeddings
from passages.operators.hits import hit_schema, rank_schema, ranked
from passages.sources.checkpoints import materialised

# Vectors that serve as pivots, and bytes of them, which go to every task.
PIVOTS = 1024
PIVOT_BYTES = 32 << 20
# Bytes of vectors, and rows of questions, that meet in one task.
BLOCK_BYTES = 64 << 20
BLOCK_QUESTIONS = 8192
CELLS_PER_BLOCK = 2
# Slack of distances, as a share of the lengths of the vectors, for the square roots of products.
_ROOT_ERROR = 2 * nearest.PRODUCT_ERROR**0.5
# A share of no pivot is taken for one of so many.
_UNSEEN = 4


def finite_vectors(df: DataFrame, dim: int) -> DataFrame:
    """Rows with a vector of ``dim`` numbers, none of them missing or infinite."""
    known = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return valid_embeddings(df, dim).where(known)


def choose_pivots(vectors: DataFrame, dim: int, count: int = PIVOTS) -> np.ndarray:
    """At most ``count`` vectors, those whose ids hash lowest; the rest see them as any others."""
    most = min(count, PIVOT_BYTES // (8 * dim))
    rows = vectors.orderBy(F.xxhash64("id", "embedding")).limit(most).select("embedding").toArrow()
    return nearest.matrix(rows["embedding"], dim)


def _lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(axis=1))


def _in_cells(questions: DataFrame, pivots: np.ndarray, cells: int, k: int) -> DataFrame:
    """``questions`` with the ``cell`` of the nearest of the first ``cells`` pivots, the
    ``bound`` of the k-th squared distance, and the ``reach`` from the cell's pivot within
    which their neighbours lie."""
    shared = questions.sparkSession.sparkContext.broadcast(pivots)

    @F.arrow_udf("struct<cell:int,bound:double,reach:double>")
    def to_cell(embedding: pa.Array) -> pa.Array:
        pivots = shared.value
        asked = nearest.matrix(embedding, pivots.shape[1])
        cell = np.zeros(len(asked), np.int32)
        bound, reach = np.full(len(asked), np.inf), np.full(len(asked), np.inf)
        longest = _lengths(pivots).max(initial=0.0)
        for tile in nearest.tiles(len(asked), len(pivots)):
            squares = nearest.squared_distances(asked[tile], pivots)
            cell[tile] = squares[:, :cells].argmin(axis=1)
            if len(pivots) >= k:
                slack = _ROOT_ERROR * (_lengths(asked[tile]) + longest)
                far = np.sqrt(np.partition(squares, k - 1, axis=1)[:, k - 1]) + slack
                bound[tile] = far * far
                reach[tile] = np.sqrt(squares[:, :cells].min(axis=1)) + slack + far
        arrays = [pa.array(cell), pa.array(bound), pa.array(reach)]
        return pa.StructArray.from_arrays(arrays, ["cell", "bound", "reach"])

    near = to_cell.asNondeterministic()("embedding")
    return questions.withColumn("near", near).select("query_id", "embedding", "near.*")


def _to_blocks(vectors: DataFrame, pivots: np.ndarray, reach: dict[int, float], blocks: dict) -> DataFrame:
    """``cell, slice, salt, id, embedding``: a copy of each vector for every block it may matter to."""
    cells = np.array(sorted(reach), np.int32)
    limits = np.array([reach[cell] for cell in cells.tolist()])
    slices = np.array([blocks[cell][0] for cell in cells.tolist()], np.int64)
    shared = vectors.sparkSession.sparkContext.broadcast((pivots[cells], cells, limits, slices))
    salts = {cell: salt for cell, (_, salt) in blocks.items()}
    id_type, kind = (vectors.schema[c].dataType.simpleString() for c in ("id", "embedding"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, cells, limits, slices = shared.value
        every = np.array([salts[cell] for cell in cells.tolist()], np.int64)
        longest = _lengths(centers).max(initial=0.0)
        for batch in batches:
            values = nearest.matrix(batch["embedding"], centers.shape[1])
            mixed = batch["mixed"].to_numpy()
            for tile in nearest.tiles(len(values), len(centers)):
                far = np.sqrt(nearest.squared_distances(values[tile], centers))
                slack = _ROOT_ERROR * (_lengths(values[tile]) + longest)
                row, cell = np.nonzero(far - slack[:, None] <= limits)
                copies = slices[cell]
                first = np.repeat(np.cumsum(copies) - copies, copies)
                row, cell = np.repeat(row, copies) + tile.start, np.repeat(cell, copies)
                # Few rows at a time, as each may be copied to every block.
                for start in range(0, len(row), 1 << 14):
                    part = slice(start, start + (1 << 14))
                    taken = pa.array(row[part])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(cells[cell[part]]),
                            pa.array((np.arange(len(row)) - first)[part].astype(np.int32)),
                            pa.array((mixed[row[part]] % every[cell[part]]).astype(np.int32)),
                            batch["id"].take(taken),
                            batch["embedding"].take(taken),
                        ],
                        ["cell", "slice", "salt", "id", "embedding"],
                    )

    # Any salt is right, as a question goes to all salts of its cell.
    mixed = F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("mixed")
    return vectors.select("id", "embedding", mixed).mapInArrow(
        deal, f"cell int, slice int, salt int, id {id_type}, embedding {kind}"
    )


def join_nearest(
    questions: DataFrame,
    vectors: DataFrame,
    dim: int,
    k: int = 5,
    pivots: int = PIVOTS,
    block_questions: int = BLOCK_QUESTIONS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``query_id, id, distance, rank`` of the k nearest vectors of each question, exact.

    ``questions(query_id, embedding)`` and ``vectors(id, embedding)`` have unique ids; both
    are tables of any size, and of both only vectors of ``dim`` finite numbers count. The
    driver sees the pivots and a row per cell of questions, at most ``pivots`` of each. The
    vectors are read once, besides their number and the choice of the pivots, and should
    come from a table; they are copied to the blocks of questions that they may matter to,
    of which there are as many as the number of questions asks for.

    A block is a slice of a cell's questions and a part of the vectors within its reach. The
    share of pivots within reach tells how many parts a cell's vectors are dealt into,
    so that neither side of a block outgrows a task, whatever a third of either side is
    alike. Questions find nothing where there is no vector.
    """
    schema = hit_schema(questions, vectors)
    vectors = finite_vectors(vectors.select("id", "embedding"), dim)
    asked = finite_vectors(questions.select("query_id", "embedding"), dim)
    sample = choose_pivots(vectors, dim, pivots)
    if not len(sample):
        return vectors.sparkSession.createDataFrame([], rank_schema(schema))
    asked = materialised(asked)
    # Some cells per block, so that blocks are compact; few blocks, so that copies are few.
    n_cells = min(len(sample), -(-CELLS_PER_BLOCK * asked.count() // block_questions) or 1)
    asked = materialised(_in_cells(asked, sample, n_cells, k))
    # One row per pivot at most.
    cells = asked.groupBy("cell").agg(F.count("*").alias("n"), F.max("reach").alias("reach")).collect()
    reach = {r["cell"]: r["reach"] for r in cells}
    total, block_rows = vectors.count(), max(1, block_bytes // (8 * dim))
    blocks = {}
    for row in cells:
        far = np.sqrt(nearest.squared_distances(sample, sample[row["cell"]][None, :]))[:, 0]
        share = min(1.0, ((far <= row["reach"]).sum() + _UNSEEN) / len(sample))
        blocks[row["cell"]] = -(-row["n"] // block_questions), int(-(-total * share // block_rows))
    plan = [(cell, *sizes) for cell, sizes in blocks.items()]
    plan = F.broadcast(vectors.sparkSession.createDataFrame(plan, "cell int, slices int, salts int"))
    left = (
        asked.join(plan, "cell")
        .withColumn("slice", F.pmod(F.xxhash64("query_id"), F.col("slices")).cast("int"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        .drop("slices", "salts", "reach")
    )
    right = _to_blocks(vectors, sample, reach, blocks)

    def score(asked: pa.Table, found: pa.Table) -> pa.Table:
        parts = (
            (batch["id"], nearest.matrix(batch["embedding"], dim))
            for batch in found.to_batches(max_chunksize=nearest.CHUNK_ROWS)
        )
        return nearest.best_of(
            asked["query_id"].combine_chunks(),
            nearest.matrix(asked["embedding"], dim),
            parts if asked.num_rows else (),
            k,
            found.schema.field("id").type,
            asked["bound"].to_numpy(),
        )

    keys = ["cell", "slice", "salt"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, schema)
    return ranked(hits, k)
