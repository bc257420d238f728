"""Intermediate tables in the folder that all executors share, and texts dealt into groups."""

from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.sources.checkpoints import use_checkpoints

# Text of a group, which is handled as a whole, and of a bucket, which is one task.
GROUP_BYTES = 2 << 20
BUCKET_BYTES = 24 << 20


def shared_path(df: DataFrame) -> str:
    """A new path below the session's checkpoint folder."""
    use_checkpoints(df.sparkSession)
    return f"{df.sparkSession.sparkContext.getCheckpointDir()}/{uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written once as Parquet, so that no later step depends on an executor."""
    path = shared_path(df)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class TextGroups:
    """``rows(g, id, text)``, bucketed by ``g``, so that no later step moves the texts."""

    rows: DataFrame
    groups: int
    text_bytes: int


def text_groups(docs: DataFrame, id_col: str, text_col: str) -> TextGroups:
    """Ids and texts of ``docs`` dealt by hash into groups of about ``GROUP_BYTES``.

    The number of groups follows the size of all texts. A null text is an empty one. Rows
    repeated in full are dealt out by their place in the input, like any others. Texts move through one shuffle and are then read from a bucketed table.
    """
    docs = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    buckets = max(cores, -(-total // BUCKET_BYTES))
    groups = max(2 * buckets, -(-total // GROUP_BYTES))
    mixed = F.xxhash64("id", "text", F.monotonically_increasing_id())
    rows = docs.withColumn("g", F.pmod(mixed, F.lit(groups)).cast("int"))
    name = f"texts_{uuid4().hex}"
    (
        rows.repartition(buckets, "g")
        .write.bucketBy(buckets, "g")
        .format("parquet")
        .option("path", shared_path(docs))
        .option("compression", "zstd")
        .saveAsTable(name)
    )
    return TextGroups(docs.sparkSession.table(name), groups, total)
