from pathlib import Path

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from passages.sources import upsert
from passages.sources.tables import table_info
from passages.sources.upsert import upsert_table

SCHEMA = StructType(
    [StructField("k", LongType()), StructField("v", StringType()), StructField("p", StringType())]
)
FIRST = [(1, "a", "x"), (2, "b", "x"), (3, "c", "y"), (4, "d", None), (None, "n", "z"), (5, "e", "w")]


@pytest.fixture
def table(spark, request):
    name = f"default.{request.node.originalname}"
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def _upsert(spark, table, rows, **options):
    options = {"keys": ["k"], "partition_cols": ["p"]} | options
    upsert_table(spark, spark.createDataFrame(rows, SCHEMA), SCHEMA, table, **options)


def _rows(spark, table):
    return sorted((tuple(r) for r in spark.table(table).select("k", "v", "p").collect()), key=repr)


def _files(spark, table):
    root = Path(table_info(spark, table).properties["location"].removeprefix("file:"))
    return {str(f.relative_to(root)): f.stat().st_mtime_ns for f in root.rglob("*.parquet")}


def _expected(rows, changes):
    changed = {r[0] for r in changes}
    return sorted([r for r in rows if r[0] not in changed] + list(changes), key=repr)


CHANGES = [(1, "aa", "x"), (3, "cc", "x"), (None, "nn", "z"), (9, "new", "it's"), (9, "twice", "x")]


def test_rows_of_changed_keys_are_replaced(spark, table):
    _upsert(spark, table, FIRST)
    assert _rows(spark, table) == sorted(FIRST, key=repr)
    _upsert(spark, table, CHANGES)
    wanted = _expected(FIRST, CHANGES)
    assert _rows(spark, table) == wanted
    _upsert(spark, table, CHANGES)  # as after a write that failed
    assert _rows(spark, table) == wanted
    _upsert(spark, table, [])
    assert _rows(spark, table) == wanted


def test_files_of_other_partitions_are_not_touched(spark, table):
    _upsert(spark, table, FIRST)
    before = _files(spark, table)
    _upsert(spark, table, [(3, "cc", "x")])  # leaves y empty
    after = _files(spark, table)
    assert {f for f in before if f.startswith(("p=w", "p=z", "p=__"))} == {
        f for f in before if after.get(f) == before[f]
    }
    assert not any(f.startswith("p=y") for f in after if "part" in f and spark.read.parquet(
        table_info(spark, table).properties["location"]).where("p = 'y'").count())
    assert _rows(spark, table) == _expected(FIRST, [(3, "cc", "x")])


def test_a_null_partition_can_be_left_and_entered(spark, table):
    _upsert(spark, table, FIRST)
    _upsert(spark, table, [(4, "d", "x"), (1, "a", None)])
    assert _rows(spark, table) == _expected(FIRST, [(4, "d", "x"), (1, "a", None)])


def test_keys_with_the_partition_read_only_partitions_of_the_changes(spark, table, monkeypatch):
    keys = {"keys": ["p", "k"]}
    _upsert(spark, table, FIRST, **keys)
    seen = []
    inside = upsert._in_partitions

    def watched(rows, partitions, columns):
        found = inside(rows, partitions, columns)
        seen.append((partitions.collect(), found._jdf.queryExecution().executedPlan().toString()))
        return found

    monkeypatch.setattr(upsert, "_in_partitions", watched)
    _upsert(spark, table, [(1, "moved", "y")], **keys)
    assert _rows(spark, table) == sorted([*FIRST, (1, "moved", "y")], key=repr)
    assert [r["p"] for r in seen[0][0]] == ["y"]
    assert "PartitionFilters: [(p" in seen[0][1] and "InMemoryFileIndex(1 paths)" in seen[0][1]


def test_many_partitions_are_found_by_a_join(spark, table, monkeypatch):
    monkeypatch.setattr(upsert, "NAMED_PARTITIONS", 1)
    _upsert(spark, table, FIRST)
    _upsert(spark, table, CHANGES)
    assert _rows(spark, table) == _expected(FIRST, CHANGES)


def test_a_table_without_partitions(spark, table):
    _upsert(spark, table, FIRST, partition_cols=None)
    _upsert(spark, table, CHANGES, partition_cols=None)
    assert _rows(spark, table) == _expected(FIRST, CHANGES)


def test_bad_keys(spark, table):
    for options, message in (({"keys": []}, "no keys"), ({"keys": ["q"]}, "no such key")):
        with pytest.raises(ValueError, match=message):
            _upsert(spark, table, FIRST, **options)
    assert not spark.catalog.tableExists(table)
