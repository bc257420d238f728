import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from passages.operators.embedding import add_lexical_embedding, lexical_model
from passages.params import (
    CaptionsParams,
    ChunkParams,
    EmbeddingParams,
    parse_params,
    read_params,
)
from passages.plans.answers import answer_questions
from passages.plans.__main__ import main
from passages.plans.jobs import answers_job, captions_job, chunk_job, embedding_job
from passages.schemas import ANSWERS, CONTENT, CONTENT_CHUNKS_EMBEDDING, MISSING_TRANSCRIPTS
from passages.sources.landing import read_captions, read_playlist_pages
from passages.sources.tables import table_info

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COMMON = {"env": "test", "database": "jobs"}
CONFIG = {
    "video_captions": {**COMMON, "channel_id": "UCabc"},
    "chunk": COMMON,
    "embedding": {**COMMON, "endpoint_name": "e"},
    "retriever": {**COMMON, "table_url": "t"},
    "chat": {**COMMON, "endpoint_name": "c"},
}


def test_defaults():
    params = parse_params(CONFIG)
    assert (params.chunk.chunk_size, params.chunk.chunk_overlap) == (500, 50)
    assert (params.video_captions.timeout, params.video_captions.language) == (60, "en")
    assert (params.retriever.k, params.retriever.M) == (5, 32)
    assert (params.retriever.efConstruction, params.retriever.efSearch) == (40, 10)
    assert (params.chat.temperature, params.chat.max_tokens) == (0.0, 500)
    assert params.chunk.catalog is None


def test_values_are_checked():
    with pytest.raises(ValueError, match="missing sections: chat"):
        parse_params({k: v for k, v in CONFIG.items() if k != "chat"})
    with pytest.raises(ValueError, match="database"):
        parse_params({**CONFIG, "chunk": {"env": "test"}})
    with pytest.raises(ValueError, match="chunk_size"):
        parse_params({**CONFIG, "chunk": {**COMMON, "chunk_size": "many"}})
    with pytest.raises(ValueError, match="env"):
        parse_params({**CONFIG, "chunk": {"env": 3, "database": "d"}})


def test_read_files(tmp_path):
    (tmp_path / "conf.json").write_text(json.dumps(CONFIG))
    assert read_params(str(tmp_path / "conf.json")) == parse_params(CONFIG)
    yaml = pytest.importorskip("yaml")
    (tmp_path / "conf.yml").write_text(yaml.safe_dump(CONFIG))
    assert read_params(str(tmp_path / "conf.yml")) == parse_params(CONFIG)


def _make_chat():
    return lambda texts: [f"answer of {len(t)}" for t in texts]


def test_jobs_in_a_row(spark, tmp_path, golden):
    text, parts, _ = golden
    snippet = {
        "title": "t",
        "publishedAt": "2024-08-09T16:03:23Z",
        "resourceId": {"videoId": "v"},
    }
    silent = {**snippet, "resourceId": {"videoId": "w"}}
    page = {"playlist_id": "UULFabc", "items": [{"snippet": snippet}, {"snippet": silent}]}
    words = text.split(" ")
    said = [
        {"start": float(i), "duration": 1.0, "text": " ".join(words[i : i + 8])}
        for i in range(0, len(words), 8)
    ]
    landed = {"video_id": "v", "language": "en", "transcript": said}
    for name, row in (("pages", page), ("captions", landed)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "1.json").write_text(json.dumps(row))

    spark.sql("CREATE DATABASE IF NOT EXISTS jobs")
    pages = read_playlist_pages(spark, str(tmp_path / "pages"))
    captions = read_captions(spark, str(tmp_path / "captions"))
    missing = captions_job(spark, CaptionsParams(**CONFIG["video_captions"]), pages, captions)
    assert [r["video_id"] for r in missing.collect()] == ["w"]
    assert spark.table("jobs.missing_transcripts").schema == MISSING_TRANSCRIPTS
    assert spark.table("jobs.transcripts").count() == len(said)
    assert spark.table("jobs.content").first()["content"] == text

    chunk_job(spark, ChunkParams(**COMMON, chunk_size=25, chunk_overlap=5))
    chunks = spark.table("jobs.content_chunks").orderBy("id").collect()
    assert [r["content"] for r in chunks] == parts
    assert [r["id"] for r in chunks] == [f"UCabc_v_{i}" for i in range(4)]

    embedding_job(spark, EmbeddingParams(**CONFIG["embedding"]), lambda name: lexical_model(32))
    vectors = spark.table("jobs.content_chunks_embedding")
    assert vectors.schema == CONTENT_CHUNKS_EMBEDDING

    asked = spark.createDataFrame([(1, parts[2]), (2, parts[1])], "query_id int, input string")
    questions = add_lexical_embedding(asked, 32, "input")
    answers = answer_questions(questions, vectors, _make_chat, k=2).orderBy("query_id").collect()
    assert [r["context"][0]["id"] for r in answers] == ["UCabc_v_2", "UCabc_v_1"]
    assert all(len(r["context"]) == 2 and r["answer"].startswith("answer of") for r in answers)
    assert answers[0]["context"][0].asDict().keys() == {
        "id", "video_id", "title", "publish_time", "content",
    }

    location = table_info(spark, "jobs.content_chunks_embedding").properties["location"]
    retriever = {**CONFIG["retriever"], "table_url": location, "k": 2}
    answers_job(
        spark,
        parse_params({**CONFIG, "retriever": retriever}),
        asked,
        lambda name: lexical_model(32),
        lambda name, temperature, max_tokens: lambda texts: [f"{name} {max_tokens}"] * len(texts),
        fmt="parquet",
    )
    stored = spark.table("jobs.answers").orderBy("query_id")
    assert stored.schema == ANSWERS
    assert [(r["answer"], r["context"][0]["id"]) for r in stored.collect()] == [
        ("c 500", "UCabc_v_2"),
        ("c 500", "UCabc_v_1"),
    ]

    config = {**CONFIG, "chunk": {**COMMON, "chunk_size": 40, "chunk_overlap": 5}}
    (tmp_path / "conf.json").write_text(json.dumps(config))
    main(["chunk", "--conf-file", str(tmp_path / "conf.json")])
    assert spark.table("jobs.content_chunks").count() < 4
    with pytest.raises(SystemExit):
        main(["embedding", "--conf-file", str(tmp_path / "conf.json")])
    spark.sql("DROP DATABASE jobs CASCADE")


def test_jobs_choose_the_format_of_their_tables(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS formats")
    common = {"env": "test", "database": "formats", "catalog": "spark_catalog", "table_format": "orc"}
    rows = [("c", "v", "t", None, "one two three")]
    spark.createDataFrame(rows, CONTENT).write.saveAsTable("formats.content")
    chunk_job(spark, ChunkParams(**common, chunk_size=25, chunk_overlap=5))
    assert table_info(spark, "formats.content_chunks").properties["provider"] == "orc"
    assert spark.table("formats.content_chunks").first()["content"] == "one two three"
    assert parse_params({**CONFIG, "chunk": common}).chunk.table_format == "orc"
    spark.sql("DROP DATABASE formats CASCADE")


def test_embedded_rows_keep_their_columns(spark):
    df = spark.range(3).withColumn("content", F.lit("a b"))
    assert add_lexical_embedding(df, 4).columns == ["id", "content", "embedding"]
