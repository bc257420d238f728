"""Comparison of two frames, sorting and numbering of rows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from passages.sources.checkpoints import materialised

INDEX = "row_index"


def round_numbers(df: DataFrame, digits: int = 2) -> DataFrame:
    """Every numeric column rounded."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, NumericType)]
    return df.withColumns({name: F.round(name, digits) for name in numeric})


def _nulls_last(columns: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in columns]


def sort_nulls_last(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Sorted by the columns (all by default), nulls after the other values.

    Equal rows are ranged by the task they come from as well, so that many copies of
    one row are spread over several tasks; the order of the columns is not affected.
    """
    columns = columns or df.columns
    order = [*_nulls_last(columns), F.col("__task")]
    return (
        df.withColumn("__task", F.spark_partition_id())
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .drop("__task")
    )


def with_row_index(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Add the position, from 0, of each row in the order of the columns, nulls last.

    One sort over all tasks. Each row's place within its partition is fixed with the
    sorted rows by a checkpoint, and the sizes of the partitions give the rest. Among
    rows equal in all columns the order is arbitrary.
    """
    ordered = materialised(
        sort_nulls_last(df, columns).withColumn("__place", F.monotonically_increasing_id())
    )
    part = F.shiftright("__place", 33)
    within = F.col("__place").bitwiseAND((1 << 33) - 1)
    # One row per partition.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ordered.groupBy(part.alias("__part"))
        .agg(F.count("*").alias("n"))
        .select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    )
    return (
        ordered.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")
        .withColumn(INDEX, F.col("__offset") + within)
        .drop("__part", "__offset", "__place")
    )


def same_schema(left: DataFrame, right: DataFrame) -> bool:
    return left.dtypes == right.dtypes


def frame_diff(left: DataFrame, right: DataFrame, digits: int | None = None) -> DataFrame:
    """Rows that occur more often on one side: the columns, ``side`` and ``copies``.

    Compares as bags. Both sides are counted in one grouping, which adds up copies of
    a row before the shuffle. Numbers are rounded first if ``digits`` is given.
    """
    if not same_schema(left, right):
        raise ValueError(f"schemas differ: {left.dtypes} and {right.dtypes}")
    if digits is not None:
        left, right = round_numbers(left, digits), round_numbers(right, digits)
    signed = left.withColumn("__n", F.lit(1)).unionAll(right.withColumn("__n", F.lit(-1)))
    excess = F.col("__n")
    return (
        signed.groupBy(*left.columns)
        .agg(F.sum("__n").alias("__n"))
        .where(excess != 0)
        .select(
            *left.columns,
            F.when(excess > 0, F.lit("left")).otherwise(F.lit("right")).alias("side"),
            F.abs(excess).alias("copies"),
        )
    )


def frames_equal(
    left: DataFrame,
    right: DataFrame,
    digits: int | None = None,
    order: list[str] | None = None,
) -> bool:
    """Same columns and types, and the same rows as often. With ``order``, the rows
    are also compared position by position after sorting by these columns."""
    if not same_schema(left, right):
        return False
    if order:
        left, right = with_row_index(left, order), with_row_index(right, order)
    return frame_diff(left, right, digits).isEmpty()
