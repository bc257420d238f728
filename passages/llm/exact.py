"""Exact duplicates by sorting contents."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passages.llm.shared import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Characters of a text that its place in the sort is first decided by.
HEAD = 32


def ascii_lower(text: Column) -> Column:
    """``text`` with only A-Z lower-cased; ``lower`` does that where all is ASCII, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest"
) -> DataFrame:
    """``id, keep_id, group_size, kept, digest`` of every row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    ``digest`` is the SHA-256 of the normalised text. Spark samples splitters, ranges
    of normalised texts go to tasks, each sorts its range (on disk where it must), and
    neighbours are compared in full. A text with very many copies would be one task's
    range, so the second sort key is one of as many slices of the ids as there are
    ranges: its copies are then neighbouring runs in several tasks. Each run yields its
    best id and its length; one row per run, without the text, goes on to meet the
    other runs of that text by the digest.

    Of equal texts the row with the smallest id stays (``keep="largest"``: the largest).
    A null id comes last; of rows repeated with one id and text, one stays. An empty
    table gives an empty result. Other columns of ``docs``, of any name, are left out.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col(id_col).alias("id"),
        ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(ranges)).alias("slice"),
    )
    # Whole texts as splitters would be too much for the driver, which gathers the sample.
    rows = rows.withColumn("head", F.substring("text", 1, HEAD)).repartitionByRange(
        ranges, "head", "slice"
    )
    best = F.min if keep == "smallest" else F.max
    first = F.col("id").asc_nulls_last() if keep == "smallest" else F.col("id").desc_nulls_last()
    run = W.partitionBy("head", "slice", "text")
    runs = saved(
        rows.select(
            "id",
            "slice",
            F.sha2(F.col("text"), 256).alias("digest"),
            F.row_number().over(run.orderBy(first)).alias("place"),
            F.count(F.lit(1)).over(run).alias("run_size"),
            best("id").over(run).alias("run_best"),
        )
    )
    groups = (
        runs.where("place = 1")
        .groupBy("digest")
        .agg(
            best("run_best").alias("keep_id"),
            F.sum("run_size").alias("group_size"),
            F.collect_list("slice").alias("slices"),
        )
        .select("digest", "keep_id", "group_size", F.explode("slices").alias("slice"))
    )
    kept = (F.col("place") == 1) & F.col("id").eqNullSafe(F.col("keep_id"))
    return runs.join(groups, ["digest", "slice"]).select(
        "id", "keep_id", "group_size", kept.alias("kept"), "digest"
    )


def without_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest"
) -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with all their columns."""
    kept = (
        exact_duplicates(docs, id_col, text_col, keep)
        .where("kept")
        .select(F.col("id").alias("__id"), F.col("digest").alias("__digest"))
    )
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.withColumns(
        {"__known": F.coalesce(F.col(id_col).cast("string"), F.lit("")), "__sha": F.sha2(text, 256)}
    )
    kept = kept.select(
        F.coalesce(F.col("__id").cast("string"), F.lit("")).alias("__known"),
        F.col("__digest").alias("__sha"),
    )
    # Rows repeated in full meet here; the join has brought them together already.
    place = F.row_number().over(W.partitionBy("__known", "__sha").orderBy(F.lit(1)))
    return (
        rows.join(kept, ["__known", "__sha"], "left_semi")
        .withColumn("__place", place)
        .where("__place = 1")
        .select(*docs.columns)
    )
