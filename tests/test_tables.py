import pytest
from pyspark.errors import AnalysisException
from pyspark.sql.types import StringType, StructField, StructType

from passages.operators.compare import frames_equal
from passages.schemas import CONTENT, CONTENT_CHUNKS, CONTENT_CHUNKS_EMBEDDING, TRANSCRIPTS
from passages.sources.spread import spread
from passages.sources.tables import (
    create_table,
    qualified_name,
    read_shared,
    read_table,
    table_info,
    without_columns,
    write_table,
)

SCHEMA = StructType(
    [StructField(n, StringType()) for n in ("channel_id", "video_id", "title", "content")]
)


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([("c1", "v1", "t", "x"), ("c2", "v2", "u", None)], SCHEMA)


@pytest.fixture
def table(spark, request):
    name = f"default.{request.node.originalname}"
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_declared_columns():
    assert TRANSCRIPTS.fieldNames() == [
        "channel_id", "video_id", "title", "publish_time", "start", "duration", "text",
    ]
    assert CONTENT.fieldNames()[-1] == "content"
    assert CONTENT_CHUNKS.fieldNames() == ["id", *CONTENT.fieldNames()]
    assert CONTENT_CHUNKS_EMBEDDING["embedding"].dataType.simpleString() == "array<float>"
    assert all(f.nullable for f in CONTENT_CHUNKS_EMBEDDING)


def test_qualified_name():
    assert qualified_name("content", "dev") == "dev.content"
    assert qualified_name("content", "dev", "my-catalog") == "`my-catalog`.dev.content"


def test_write_and_read(spark, rows, table):
    write_table(spark, rows, SCHEMA, table)
    info = table_info(spark, table)
    assert info.properties["type"] == "MANAGED" and info.partition_columns == []
    assert info.columns == {n: "string" for n in SCHEMA.fieldNames()}
    assert frames_equal(read_table(spark, table.split(".")[1], "default"), rows)


def test_overwrite_replaces_and_append_adds(spark, rows, table):
    write_table(spark, rows, SCHEMA, table)
    write_table(spark, rows.limit(1), SCHEMA, table)
    assert spark.table(table).count() == 1
    write_table(spark, rows, SCHEMA, table, mode="append")
    assert spark.table(table).count() == 3
    with pytest.raises(ValueError):
        write_table(spark, rows, SCHEMA, table, mode="ignore")


def test_columns_are_projected_to_the_schema(spark, rows, table):
    shuffled = rows.selectExpr("content", "title", "video_id", "channel_id", "1 AS more")
    write_table(spark, shuffled, SCHEMA, table)
    assert frames_equal(spark.table(table), rows)
    with pytest.raises(AnalysisException):
        write_table(spark, rows.drop("title"), SCHEMA, table)


def test_overwrite_keeps_partitions_without_new_rows(spark, rows, table):
    write_table(spark, rows, SCHEMA, table, partition_cols=["channel_id"])
    changed = spark.createDataFrame([("c2", "v3", "w", "y")], SCHEMA)
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    write_table(spark, changed, SCHEMA, table, partition_cols=["channel_id"])
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before
    found = spark.table(table).select(*SCHEMA.fieldNames())
    assert sorted(map(tuple, found.collect())) == [("c1", "v1", "t", "x"), ("c2", "v3", "w", "y")]


def test_columns_meet_by_name(spark, rows, table):
    spark.sql(f"CREATE TABLE {table} (title string, content string, video_id string, channel_id string)")
    write_table(spark, rows, SCHEMA, table)
    assert frames_equal(spark.table(table).select(*SCHEMA.fieldNames()), rows)


@pytest.mark.parametrize(
    ("definition", "partition_cols", "reason"),
    [
        ("channel_id string, video_id string, title string", None, "content is not in the table"),
        ("channel_id string, video_id string, title string, content string, more int", None, "not declared"),
        ("channel_id string, video_id string, title int, content string", None, "title is int"),
        ("channel_id string, video_id string, title string, content string", ["channel_id"], "partitioned by"),
    ],
)
def test_tables_of_another_form_are_left_alone(spark, rows, table, definition, partition_cols, reason):
    spark.sql(f"CREATE TABLE {table} ({definition})")
    with pytest.raises(ValueError, match=reason):
        write_table(spark, rows, SCHEMA, table, partition_cols=partition_cols)
    assert spark.table(table).count() == 0


def test_another_partitioning_and_other_types_are_errors(spark, rows, table):
    write_table(spark, rows, SCHEMA, table, partition_cols=["channel_id"])
    assert table_info(spark, table).partition_columns == ["channel_id"]
    with pytest.raises(ValueError, match="partitioned by"):
        write_table(spark, rows, SCHEMA, table)
    with pytest.raises(ValueError, match="title is int"):
        write_table(spark, rows.selectExpr("channel_id", "video_id", "1 AS title", "content"), SCHEMA, table)
    assert spark.table(table).count() == 2


def test_a_column_named_like_a_property(spark, table):
    schema = StructType([StructField("Type", StringType()), StructField("b", StringType())])
    create_table(spark, schema, table)
    assert table_info(spark, table).columns == {"Type": "string", "b": "string"}


def test_checkpoints_off_a_local_master(monkeypatch):
    from types import SimpleNamespace

    from passages.sources.checkpoints import use_checkpoints

    known = {"spark.sql.warehouse.dir": "file:/warehouse"}
    used = []
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None, setCheckpointDir=used.append)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: known.get(k, d)))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        use_checkpoints(session)
    known["spark.checkpoint.dir"] = "hdfs:/shared"
    use_checkpoints(session)
    assert used == ["hdfs:/shared"]


def test_external_location(spark, rows, table, tmp_path):
    write_table(spark, rows, SCHEMA, table, path=str(tmp_path / "data"))
    assert table_info(spark, table).properties["type"] == "EXTERNAL"
    assert frames_equal(read_shared(spark, str(tmp_path / "data"), "parquet"), rows)


def test_create_is_idempotent(spark, rows, table):
    create_table(spark, SCHEMA, table)
    write_table(spark, rows, SCHEMA, table)
    create_table(spark, SCHEMA, table)
    assert spark.table(table).count() == 2


def test_nested_schema_as_table(spark, table):
    create_table(spark, CONTENT_CHUNKS_EMBEDDING, table)
    assert spark.table(table).schema == CONTENT_CHUNKS_EMBEDDING


def test_without_columns():
    assert without_columns(SCHEMA, ["title", "absent"]).fieldNames() == [
        "channel_id", "video_id", "content",
    ]


def test_spread_only_where_needed(spark):
    few = spark.range(100, numPartitions=1)
    assert spread(few, 3).rdd.getNumPartitions() == 3
    many = spark.range(100, numPartitions=8)
    assert spread(many, 3) is many


def test_spread_does_not_run_its_input(spark):
    group = "spread without a job"
    spark.sparkContext.setJobGroup(group, group)
    spread(spark.range(100).groupBy("id").count(), 3)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == []
