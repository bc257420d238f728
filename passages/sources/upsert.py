"""Upsert by key into a catalog table: only the partitions that change are rewritten."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from passages.sources.checkpoints import materialised
from passages.sources.tables import DEFAULT_FORMAT, create_table, table_info, write_table

# Partitions that a filter names one by one; more are found by a join.
NAMED_PARTITIONS = 1000


def _same(left: str, right: str, columns: list[str]) -> Column:
    equal = [F.col(f"{left}.`{c}`").eqNullSafe(F.col(f"{right}.`{c}`")) for c in columns]
    return reduce(lambda a, b: a & b, equal)


def _in_partitions(rows: DataFrame, partitions: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` of the given partitions. Few of them become a filter on the partition columns,
    so that no other file is opened; the driver sees at most ``NAMED_PARTITIONS`` of them."""
    named = partitions.limit(NAMED_PARTITIONS + 1).collect()
    if len(named) > NAMED_PARTITIONS:
        return rows.alias("r").join(partitions.alias("p"), _same("r", "p", columns), "left_semi")

    def is_it(partition) -> Column:
        values = zip(columns, partition, strict=True)
        return reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.lit(v)) for c, v in values])

    return rows.where(reduce(lambda a, b: a | b, map(is_it, named), F.lit(False)))


def upsert_table(
    spark: SparkSession,
    changes: DataFrame,
    schema: StructType,
    table: str,
    keys: list[str],
    partition_cols: list[str] | None = None,
    path: str | None = None,
    fmt: str = DEFAULT_FORMAT,
) -> None:
    """Rows of the table whose key is in ``changes`` are replaced by the rows there.

    All rows of a key are replaced together, so a key may stand for several rows; a null in
    a key equals a null. Rows of other keys stay, new keys are added, and a key whose
    partition changes leaves the old one. The partitions that hold rows of a changed key, old or new, are
    read, merged, staged, and then swapped in one write; files of the others are not
    touched. Which old ones those are costs a scan of the key and partition columns, unless
    the keys hold the partition columns: then only the partitions of ``changes`` are read. A
    table without partitions is merged as a whole. Changes that are applied again change
    nothing, so a write that failed can be repeated.

    The table is created if needed, and ``changes`` are checked as ``write_table`` does.
    """
    partition_cols = partition_cols or []
    unknown = [c for c in [*keys, *partition_cols] if c not in schema.fieldNames()]
    if unknown or not keys:
        raise ValueError(f"no such key or partition columns: {unknown}" if unknown else "no keys")
    changes = materialised(changes.select(*(f"`{name}`" for name in schema.fieldNames())))
    create_table(spark, schema, table, partition_cols, path, fmt)
    current = spark.table(table).select(*(f"`{name}`" for name in schema.fieldNames()))
    changed = changes.select(*keys).distinct()
    reached = current
    if partition_cols:
        touched = changes.select(*partition_cols)
        if not set(partition_cols) <= set(keys):
            columns = list(dict.fromkeys([*keys, *partition_cols]))
            old = current.select(*columns).alias("c")
            old = old.join(changed.alias("k"), _same("c", "k", keys), "left_semi")
            touched = touched.unionByName(old.select(*partition_cols))
        touched = materialised(touched.distinct())
        reached = _in_partitions(current, touched, partition_cols)
    kept = reached.alias("c").join(changed.alias("k"), _same("c", "k", keys), "left_anti")
    # Staged, as the write replaces the files that are read here.
    merged = materialised(kept.unionByName(changes))
    write_table(spark, merged, schema, table, "overwrite", partition_cols, path, fmt)
    # Keys that hold the partition columns leave no partition without rows.
    if partition_cols and not set(partition_cols) <= set(keys):
        left = merged.select(*partition_cols).distinct().alias("m")
        emptied = touched.alias("t").join(left, _same("t", "m", partition_cols), "left_anti")
        _empty(spark, table, materialised(emptied).coalesce(1), partition_cols)


def _empty(spark: SparkSession, table: str, partitions: DataFrame, columns: list[str]) -> None:
    """Overwrite each of ``partitions``, from which all rows have moved, with no rows."""
    kinds = table_info(spark, table).columns
    none = ", ".join(f"CAST(null AS {kind})" for c, kind in kinds.items() if c not in columns)
    names = ", ".join(f"`{c}` = {{}}" for c in columns)
    for values in partitions.toLocalIterator():
        marks = {f"v{i}": value for i, value in enumerate(values) if value is not None}
        spec = names.format(*(f":v{i}" if f"v{i}" in marks else "null" for i in range(len(columns))))
        spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION ({spec}) SELECT {none} WHERE false", marks)
