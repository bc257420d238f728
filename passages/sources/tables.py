"""Catalog tables: names, scans, creation and writes under a declared schema."""

import json
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

DEFAULT_FORMAT = "parquet"


def qualified_name(table: str, database: str, catalog: str | None = None) -> str:
    name = f"{database}.{table}"
    return f"`{catalog}`.{name}" if catalog else name


def read_table(
    spark: SparkSession, table: str, database: str, catalog: str | None = None
) -> DataFrame:
    return spark.read.table(qualified_name(table, database, catalog))


def read_shared(spark: SparkSession, url: str, fmt: str = "deltaSharing") -> DataFrame:
    """A table at an address, as a distributed frame."""
    return spark.read.format(fmt).load(url)


def create_table(
    spark: SparkSession,
    schema: StructType,
    table: str,
    partition_cols: list[str] | None = None,
    path: str | None = None,
    fmt: str = DEFAULT_FORMAT,
) -> None:
    """Create the table unless it exists; with ``path`` its data lies there."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    statement = f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING {fmt}"
    if partition_cols:
        statement += " PARTITIONED BY ({})".format(", ".join(f"`{c}`" for c in partition_cols))
    if path:
        statement += " LOCATION '{}'".format(path.replace("'", "\\'"))
    spark.sql(statement)


@contextmanager
def _overwrite_only_written_partitions(spark: SparkSession) -> Iterator[None]:
    # The writer option of the same name is not honoured for catalog tables: it
    # empties the partitions that the input does not hold. The session setting is.
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    spark.conf.set(key, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _differences(schema: StructType, partition_cols: list[str], info: "TableInfo") -> list[str]:
    declared = {f.name: f.dataType.simpleString() for f in schema}
    found = [f"column {n} is not in the table" for n in declared if n not in info.columns]
    found += [f"column {n} is not declared" for n in info.columns if n not in declared]
    found += [
        f"column {n} is {info.columns[n]}, declared {kind}"
        for n, kind in declared.items()
        if info.columns.get(n, kind) != kind
    ]
    if list(partition_cols) != info.partition_columns:
        found.append(f"partitioned by {info.partition_columns}, not by {list(partition_cols)}")
    return found


def write_table(
    spark: SparkSession,
    df: DataFrame,
    schema: StructType,
    table: str,
    mode: str = "overwrite",
    partition_cols: list[str] | None = None,
    path: str | None = None,
    fmt: str = DEFAULT_FORMAT,
) -> None:
    """Create the table if needed and write the declared columns to it, by name.

    A table whose columns, types or partition columns are not the declared ones is left
    alone, with a ValueError. Overwriting a partitioned table replaces only the partitions
    found in ``df``. Extra columns of ``df`` are left out, a missing one, or one of another
    type, is an error.
    """
    if mode not in ("overwrite", "append"):
        raise ValueError(f"mode must be overwrite or append, not {mode!r}")
    partition_cols = partition_cols or []
    rows = df.select(*(f"`{name}`" for name in schema.fieldNames()))
    wrong = [
        f"column {have.name} is {have.dataType.simpleString()}, declared {want.dataType.simpleString()}"
        for have, want in zip(rows.schema, schema, strict=True)
        if have.dataType.simpleString() != want.dataType.simpleString()
    ]
    if wrong:
        raise ValueError("; ".join(wrong))
    create_table(spark, schema, table, partition_cols, path, fmt)
    info = table_info(spark, table)
    wrong = _differences(schema, partition_cols, info)
    if wrong:
        raise ValueError(f"{table}: {'; '.join(wrong)}")
    # insertInto matches columns by position, so they are put in the table's own order.
    rows = rows.select(*(f"`{name}`" for name in info.columns))
    if partition_cols:
        # Rows of a partition meet in few tasks, and so in few files; adaptive execution
        # divides a partition that is too large for one.
        rows = rows.hint("rebalance", *partition_cols)
    with _overwrite_only_written_partitions(spark):
        rows.write.insertInto(table, overwrite=mode == "overwrite")


@dataclass(frozen=True)
class TableInfo:
    """What the catalog knows of a table; ``columns`` maps names to types, in stored order."""

    columns: dict[str, str]
    partition_columns: list[str]
    properties: dict[str, object]


def table_info(spark: SparkSession, table: str) -> TableInfo:
    described = json.loads(spark.sql(f"DESCRIBE TABLE EXTENDED {table} AS JSON").first()[0])
    described.pop("columns", None)
    partition_columns = described.pop("partition_columns", None) or []
    schema = spark.table(table).schema
    return TableInfo(
        {field.name: field.dataType.simpleString() for field in schema},
        [c["name"] if isinstance(c, dict) else c for c in partition_columns],
        described,
    )


def without_columns(schema: StructType, columns: Iterable[str]) -> StructType:
    """The schema less the named columns, in its order; unknown names are ignored."""
    left = set(schema.fieldNames()).difference(columns)
    return StructType([schema[name] for name in schema.fieldNames() if name in left])
