"""What the physical plans must and must not contain."""

import json

import pytest
from pyspark.sql import functions as F

from passages.operators.chunking import chunk_content, chunk_words
from passages.operators.compare import frame_diff
from passages.operators.embedding import add_lexical_embedding
from passages.operators.transcripts import missing_transcripts, nest_captions
from passages.plans.table_queries import QUERIES
from passages.sources.landing import captions_in_language
from tests.test_queries import FOLDER, pytestmark  # noqa: F401


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stored"))
    spark.range(100, numPartitions=4).select(
        F.lit("c").alias("channel_id"),
        F.col("id").cast("string").alias("video_id"),
        F.lit("en").alias("language"),
        F.col("id").cast("double").alias("start"),
        F.lit(1.0).alias("duration"),
        F.lit("t").alias("title"),
        F.lit("some text").alias("text"),
        F.lit("some text").alias("content"),
    ).write.parquet(folder + "/t")
    return spark.read.parquet(folder + "/t")


def _content(stored):
    return stored.select("channel_id", "video_id", "title", "content")


def test_chunking_and_vectors_do_not_shuffle(stored):
    for chunks in (chunk_content(_content(stored)), chunk_words(_content(stored))):
        text = plan(add_lexical_embedding(chunks, 16))
        assert "Exchange" not in text
        assert "BatchEvalPython" not in text
    assert plan(chunk_content(_content(stored))).count("ArrowEvalPython") == 1
    assert "Python" not in plan(chunk_words(_content(stored)))


def test_language_reaches_the_scan(stored):
    captions = nest_captions(
        stored.select("video_id", "language", "start", "duration", "text"),
        ["video_id", "language"],
    )
    text = plan(captions_in_language(captions, "en"))
    assert "EqualTo(language,en)" in text
    assert "title" not in text.split("ReadSchema")[1]


def test_only_ids_are_read_to_find_missing_transcripts(stored):
    videos = stored.select("channel_id", "video_id", "title")
    captions = nest_captions(stored.select("video_id", "start", "duration", "text"), ["video_id"])
    text = plan(missing_transcripts(videos, captions))
    schemas = [part.split(">")[0] for part in text.split("ReadSchema: struct<")[1:]]
    assert sorted(schemas)[-1].startswith("video_id") and "text" not in "".join(schemas)


def test_difference_is_one_shuffle(stored):
    text = plan(frame_diff(_content(stored), _content(stored).withColumn("title", F.lit("u"))))
    assert text.count("Exchange hashpartitioning") == 1
    assert "partial_sum" in text


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_query_pairs_all_rows(spark, name):
    text = plan(QUERIES[name](spark, str(FOLDER)))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    assert "BatchEvalPython" not in text


def test_landed_json_is_read_with_the_declared_schema(spark, tmp_path):
    from passages.schemas import PLAYLIST_PAGE
    from passages.sources.landing import read_playlist_pages

    (tmp_path / "p.json").write_text(json.dumps({"playlist_id": "UULFx", "more": 1}))
    assert read_playlist_pages(spark, str(tmp_path)).schema == PLAYLIST_PAGE
