"""The batch jobs: each reads a table, applies operators and writes the next table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passages.operators.cells import read_cells
from passages.operators.chunking import chunk_content
from passages.operators.embedding import add_embedding
from passages.operators.transcripts import (
    flatten_transcripts,
    missing_transcripts,
    transcript_content,
    video_transcripts,
)
from passages.params import CaptionsParams, ChunkParams, CommonParams, EmbeddingParams, Params
from passages.plans.answers import answer_questions
from passages.schemas import (
    ANSWERS,
    CONTENT,
    CONTENT_CHUNKS,
    CONTENT_CHUNKS_EMBEDDING,
    MISSING_TRANSCRIPTS,
    TRANSCRIPTS,
)
from passages.sources.checkpoints import materialised
from passages.sources.landing import captions_in_language, channel_videos
from passages.sources.spread import spread
from passages.sources.tables import qualified_name, read_shared, read_table, write_table


def _read(spark: SparkSession, params: CommonParams, table: str) -> DataFrame:
    return read_table(spark, table, params.database, params.catalog)


def _write(spark: SparkSession, params: CommonParams, df: DataFrame, schema, table: str) -> None:
    name = qualified_name(table, params.database, params.catalog)
    write_table(spark, df, schema, name, fmt=params.table_format)


def captions_job(
    spark: SparkSession, params: CaptionsParams, pages: DataFrame, captions: DataFrame
) -> DataFrame:
    """Landed pages and captions to tables ``transcripts`` and ``content``.

    The videos that have no captions in the language, with the reason where one was
    landed, go to table ``missing_transcripts`` and are returned.
    """
    channel = spark.createDataFrame([(params.channel_id,)], "channel_id string")
    videos = channel_videos(pages, channel)
    spoken = captions_in_language(captions, params.language)
    # Both tables come from this join, which is done once.
    transcripts = materialised(video_transcripts(videos, spoken))
    _write(spark, params, flatten_transcripts(transcripts), TRANSCRIPTS, "transcripts")
    _write(spark, params, transcript_content(transcripts), CONTENT, "content")
    missing = missing_transcripts(videos, spoken)
    _write(spark, params, missing, MISSING_TRANSCRIPTS, "missing_transcripts")
    return _read(spark, params, "missing_transcripts")


def chunk_job(spark: SparkSession, params: ChunkParams, counter=None) -> None:
    """Table ``content`` to table ``content_chunks``."""
    content = spread(_read(spark, params, "content"))
    chunks = chunk_content(content, params.chunk_size, params.chunk_overlap, counter)
    _write(spark, params, chunks, CONTENT_CHUNKS, "content_chunks")


def embedding_job(spark: SparkSession, params: EmbeddingParams, make_model) -> None:
    """Table ``content_chunks`` to table ``content_chunks_embedding``.

    ``make_model(endpoint_name)`` returns the model; it runs on the workers.
    """
    endpoint = params.endpoint_name
    chunks = spread(_read(spark, params, "content_chunks"))
    embedded = add_embedding(chunks, lambda: make_model(endpoint))
    _write(spark, params, embedded, CONTENT_CHUNKS_EMBEDDING, "content_chunks_embedding")


def answers_job(
    spark: SparkSession,
    params: Params,
    questions: DataFrame,
    make_embedding_model,
    make_chat_model,
    fmt: str = "deltaSharing",
    cells_path: str | None = None,
    **options,
) -> None:
    """Answers to ``questions(query_id, input)`` to table ``answers``.

    The vector table is read from the retriever's address, and the cells to search, if
    any, from ``cells_path``; ``first_cells`` and ``complete`` are options. Of passages that
    repeat an id, the last by time of publication counts. Both models run on the workers: ``make_embedding_model(endpoint_name)`` and
    ``make_chat_model(endpoint_name, temperature, max_tokens)``.
    """
    embedder, chat = params.embedding.endpoint_name, params.chat
    vectors = read_shared(spark, params.retriever.table_url, fmt)
    asked = questions.select(F.col("query_id").cast("string").alias("query_id"), "input")
    if cells_path is not None:
        options["cells"] = read_cells(spark, cells_path)
    options.setdefault("last_by", ["publish_time"])
    embedded = add_embedding(spread(asked), lambda: make_embedding_model(embedder), text="input")
    answers = answer_questions(
        embedded,
        vectors,
        lambda: make_chat_model(chat.endpoint_name, chat.temperature, chat.max_tokens),
        k=params.retriever.k,
        **options,
    )
    _write(spark, params.chat, answers, ANSWERS, "answers")
