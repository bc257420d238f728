"""Hits to the passages they stand for, row by row or one context per question."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.sources.checkpoints import materialised

CONTEXT_FIELDS = ("id", "video_id", "title", "publish_time", "content")
# Hits go to every task when joined to the passages up to this size, which is measured.
BROADCAST_HITS_BYTES = 256 << 20
# What Spark keeps of a row beside its strings.
ROW_BYTES = 96


def marked_small(hits: DataFrame) -> DataFrame:
    """Hits, kept, and marked to be broadcast by a join if they are small enough."""
    hits = materialised(hits)
    text = F.octet_length(F.col("query_id").cast("string")) + F.octet_length(
        F.col("id").cast("string")
    )
    size = hits.agg(F.sum(text + ROW_BYTES)).first()[0] or 0
    return F.broadcast(hits) if size <= BROADCAST_HITS_BYTES else hits


def retrieved(
    hits: DataFrame,
    passages: DataFrame,
    fields: tuple[str, ...] = CONTEXT_FIELDS,
    last_by: list[str] | None = None,
) -> DataFrame:
    """``query_id, rank`` and the passage fields of each hit, one row per hit.

    Of rows that repeat an id, the last by ``last_by`` counts, then by the fields.
    """
    order = list(dict.fromkeys([*(last_by or []), *fields]))
    wanted = list(dict.fromkeys([*order, "id"]))
    joined = passages.select(*wanted).join(marked_small(hits.select("query_id", "id", "rank")), "id")
    # After the join only rows of hits are left, and copies shrink before the shuffle.
    last = F.max_by(F.struct(*fields), F.struct(*order)).alias("last")
    return joined.groupBy("query_id", "rank").agg(last).select("query_id", "rank", "last.*")


def last_of_repeated(passages: DataFrame, last_by: list[str] | None = None) -> DataFrame:
    """``passages`` with one row per id: of those that repeat one, the last by ``last_by``,
    then by all columns in turn. Only ids are shuffled where none repeats."""
    repeated = materialised(repeated_ids(passages).select("id"))
    if repeated.isEmpty():
        return passages
    columns = passages.columns
    order = list(dict.fromkeys([*(last_by or []), *(c for c in columns if c != "id")]))
    # The order holds all columns but the id, so its greatest value is the row.
    last = F.max(F.struct(*(c for c in order if c != "id"))).alias("last")
    copies = passages.join(repeated, "id", "left_semi").groupBy("id").agg(last).select("id", "last.*")
    return passages.join(repeated, "id", "left_anti").select(*columns).unionByName(copies.select(*columns))


def repeated_ids(passages: DataFrame) -> DataFrame:
    """``id, copies`` of the ids that stand for more than one row."""
    return (
        passages.groupBy("id").agg(F.count("*").alias("copies")).where(F.col("copies") > 1)
    )


def contexts(retrieved_rows: DataFrame, fields: tuple[str, ...] = CONTEXT_FIELDS) -> DataFrame:
    """``query_id, context``: the passages of each question in order of rank.

    A question has at most k rows, so the array is bounded.
    """
    rows = F.array_sort(F.collect_list(F.struct("rank", *fields)))
    return (
        retrieved_rows.groupBy("query_id")
        .agg(rows.alias("ranked"))
        .select(
            "query_id",
            F.transform("ranked", lambda r: F.struct(*[r[f].alias(f) for f in fields])).alias(
                "context"
            ),
        )
    )
