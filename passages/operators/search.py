"""The k nearest vectors of each question, exact, for few or for many questions."""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from passages.operators import nearest
from passages.operators.cells import Cells, search_cells
from passages.operators.embedding import valid_embeddings
from passages.operators.hits import hit_schema, rank_schema, ranked
from passages.operators.pivots import join_nearest
from passages.sources.checkpoints import materialised

# Questions go to every task in blocks of this size, which also bounds a task's hits.
BROADCAST_BYTES = 32 << 20
# Scans of the vectors from which on a join is made instead.
MOST_SCANS = 8
# What a hit takes in a task, besides its id.
HIT_BYTES = 64


def scan_nearest(
    questions: pa.Table, vectors: DataFrame, k: int, schema: StructType
) -> DataFrame:
    """One pass over the vectors, with all of ``questions`` at every task.

    Vectors are neither shuffled nor collected; each task returns k hits per question. A
    question is compared with the vectors of its own length.
    """
    lengths = pc.list_value_length(questions["embedding"]).combine_chunks()
    blocks = []
    for dim in pc.unique(lengths).drop_null().to_pylist():
        own = questions.filter(pc.equal(lengths, dim)).combine_chunks()
        own = own.filter(pa.array(nearest.finite(nearest.matrix(own["embedding"], dim))))
        if dim and own.num_rows:
            ids = own["query_id"].combine_chunks()
            blocks.append((dim, ids, nearest.matrix(own["embedding"], dim)))
    shared = vectors.sparkSession.sparkContext.broadcast(blocks)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, nearest.Best] = {}
        for batch in batches:
            for dim, _, matrix in shared.value:
                mask = pa.array(nearest.of_length(batch["embedding"], dim))
                own = batch.filter(mask)
                if dim not in best:
                    best[dim] = nearest.Best(matrix, k, batch.schema.field("id").type)
                best[dim].add(own["id"], nearest.matrix(own["embedding"], dim))
        for dim, query_ids, _ in shared.value:
            if dim in best:
                yield from best[dim].result(query_ids).to_batches()

    rows = vectors.select("id", "embedding").where("embedding is not null")
    return rows.mapInArrow(scan, schema)


def unsearchable(vectors: DataFrame, dim: int, embedding: str = "embedding") -> DataFrame:
    """The rows that a search for vectors of ``dim`` numbers passes over: null, another
    length, or a number that is missing or infinite."""
    usable = F.coalesce(
        (F.size(embedding) == dim)
        & F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))),
        F.lit(False),
    )
    return vectors.where(~usable)


def nearest_passages(
    questions: DataFrame,
    vectors: DataFrame,
    k: int = 5,
    broadcast_bytes: int = BROADCAST_BYTES,
    cells: Cells | None = None,
    first_cells: int = 4,
    complete: bool = True,
) -> DataFrame:
    """``query_id, id, distance, rank`` of the k nearest vectors of each question.

    ``questions(query_id, embedding)`` and ``vectors(id, embedding)`` have unique ids.
    Questions go to every task of a scan of the vectors, in as many blocks, and so scans,
    as their measured size and that of their hits ask for; vectors are not shuffled. Where
    that would be more than ``MOST_SCANS`` scans, both sides are dealt into blocks instead
    (``join_nearest``), with the same result, and no question reaches the driver. A question finds the vectors of its own length; null vectors and those with numbers
    that are not finite find nothing and are not found (``unsearchable`` lists them).

    With ``cells``, questions meet the vectors of the cells instead, with the same result
    unless ``complete=False`` stops after the ``first_cells`` of each question.

    The questions are computed here, when the plan is made, and only once, so that a
    model that embeds them is not called again. Vectors should come from a table, as each
    block of questions reads them.
    """
    schema = hit_schema(questions, vectors)
    # Renewed, as questions and vectors may be columns of one table.
    questions = materialised(
        questions.select(
            F.col("query_id").alias("query_id"), F.col("embedding").alias("embedding")
        ).where("embedding is not null")
    )
    if cells is not None:
        known = valid_embeddings(questions, cells.centers.shape[1])
        return ranked(search_cells(known, cells, k, schema, first_cells, complete), k)
    size = questions.agg(
        F.sum(
            8 * F.size("embedding").cast("long")
            + F.coalesce(F.octet_length(F.col("query_id").cast("string")), F.lit(0))
        ).alias("bytes"),
        F.count("*").alias("n"),
    ).first()
    wanted = max((size["bytes"] or 0) + size["n"] * k * HIT_BYTES, 1)
    blocks = max(1, min(-(-wanted // max(broadcast_bytes, 1)), size["n"]))
    if blocks > MOST_SCANS:
        # As many lengths as there are models.
        dims = [r[0] for r in questions.select(F.size("embedding")).distinct().collect() if r[0]]
        found = [join_nearest(questions, vectors, dim, k) for dim in dims]
        return reduce(DataFrame.unionByName, found, questions.sparkSession.createDataFrame([], rank_schema(schema)))
    found = None
    for block in range(blocks):
        part = questions
        if blocks > 1:
            number = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
            part = questions.where(number == block)
        hits = scan_nearest(part.toArrow(), vectors, k, schema)
        found = hits if found is None else found.unionAll(hits)
    return ranked(found, k)
