"""The operators applied to a folder of tables: documents, conversations and vectors.

Documents stand for video texts (source is the channel, doc_id the video),
conversations for captions (turn is the start, role the language), benchmark items
for questions.
"""

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from passages.functions.text import playlist_id, pretoken_count, published_at
from passages.operators.cells import fit_cells, read_cells, write_cells
from passages.operators.chunking import chunk_content, chunk_words
from passages.operators.codes import fit_codes, read_codes, search_codes, write_codes
from passages.operators.compare import frame_diff, sort_nulls_last, with_row_index
from passages.operators.context import contexts, last_of_repeated, retrieved
from passages.operators.embedding import (
    add_embedding,
    add_lexical_embedding,
    failed_embeddings,
    lexical_model,
)
from passages.operators.fingerprints import keyed_diff
from passages.operators.pivots import join_nearest
from passages.operators.prompts import add_answer, prompts
from passages.operators.search import nearest_passages
from passages.operators.transcripts import (
    caption_text,
    flatten_transcripts,
    missing_transcripts,
    nest_captions,
    transcript_content,
    video_transcripts,
)
from passages.params import CaptionsParams
from passages.schemas import FETCH_ERROR, LANDED_CAPTIONS, PLAYLIST_PAGE
from passages.sources.checkpoints import materialised, stored, use_checkpoints
from passages.sources.landing import captions_in_language, channel_videos, distinct_videos
from passages.sources.spread import spread
from passages.sources.tables import read_table, write_table
from passages.sources.upsert import upsert_table
from passages.streaming.landing import caption_stream, land_captions

DIM = 64
K = 5
CHUNK_SIZE, CHUNK_OVERLAP = 50, 5
# Turns per stretch when captions are gathered; a stretch is in seconds elsewhere.
STRETCH_TURNS = 4.0
# What the model of ``failed_texts`` refuses, and what marks a later copy.
REFUSED, LATER = " und ", " (later)"
# Fields of a context row that documents have.
FIELDS = ("id", "video_id", "title", "content")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _time_text(doc_id: Column) -> Column:
    """A publication time as landed, from the document's number."""
    day = F.lpad((doc_id % 28 + 1).cast("string"), 2, "0")
    return F.concat(F.lit("2024-01-"), day, F.lit("T16:03:23Z"))


def _videos(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "documents").select(
        F.col("source").alias("channel_id"),
        F.col("doc_id").cast("string").alias("video_id"),
        F.col("lang").alias("title"),
        published_at(_time_text(F.col("doc_id"))).alias("publish_time"),
    )


def _content(spark: SparkSession, folder: str) -> DataFrame:
    return spread(
        _table(spark, folder, "documents").select(
            F.col("source").alias("channel_id"),
            F.col("doc_id").cast("string").alias("video_id"),
            F.col("lang").alias("title"),
            F.col("text").alias("content"),
        )
    )


def _captions(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("video_id"),
        F.col("role").alias("language"),
        F.col("turn").cast("double").alias("start"),
        F.lit(None).cast("double").alias("duration"),
        "text",
    )


def _nested_captions(spark: SparkSession, folder: str) -> DataFrame:
    return nest_captions(_captions(spark, folder), ["video_id"], STRETCH_TURNS)


def _transcripts(spark: SparkSession, folder: str) -> DataFrame:
    return video_transcripts(_videos(spark, folder), _nested_captions(spark, folder))


def _passages(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_words(_content(spark, folder), CHUNK_SIZE, CHUNK_OVERLAP)


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return add_lexical_embedding(_passages(spark, folder), DIM)


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    items = _table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("input")
    )
    return add_lexical_embedding(items, DIM, "input")


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    """Landed playlist pages of at most 50 videos. Channels with a two-digit number
    have no "videos" playlist, so that it was answered with 404."""
    snippet = F.struct(
        F.col("lang").alias("title"),
        _time_text(F.col("doc_id")).alias("publishedAt"),
        F.struct(F.col("doc_id").cast("string").alias("videoId")).alias("resourceId"),
    )
    error = PLAYLIST_PAGE["error"].dataType
    uploads_only = F.length("source") > 4
    along = Window.partitionBy("source").orderBy("page")
    token = F.concat(F.lit("page "), F.col("page").cast("string"))
    pages = (
        _table(spark, folder, "documents")
        .groupBy("source", F.floor(F.col("doc_id") / 50).alias("page"))
        .agg(F.collect_list(F.struct(snippet.alias("snippet"))).alias("items"))
        # The first page is asked for without a token, the last one names no other.
        .withColumn("pageToken", F.when(F.lag("page").over(along).isNotNull(), token))
        .withColumn("nextPageToken", F.lead(token).over(along))
        .select(
            F.when(uploads_only, playlist_id(F.col("source"), "UU"))
            .otherwise(playlist_id(F.col("source")))
            .alias("playlist_id"),
            "pageToken",
            "nextPageToken",
            "items",
            F.lit(None).cast(error).alias("error"),
        )
    )
    missing = (
        _table(spark, folder, "documents")
        .where(uploads_only)
        .select("source")
        .distinct()
        .select(
            playlist_id(F.col("source")).alias("playlist_id"),
            F.lit(None).cast("string").alias("pageToken"),
            F.lit(None).cast("string").alias("nextPageToken"),
            F.lit(None).cast(pages.schema["items"].dataType).alias("items"),
            F.struct(F.lit(404).alias("status_code")).alias("error"),
        )
    )
    return pages.unionByName(missing)


def channel_listing(spark: SparkSession, folder: str) -> DataFrame:
    channels = _table(spark, folder, "documents").select(F.col("source").alias("channel_id"))
    return channel_videos(_pages(spark, folder), channels).select(
        "channel_id", "video_id", "title", F.unix_timestamp("publish_time").alias("published")
    )


def videos_distinct(spark: SparkSession, folder: str) -> DataFrame:
    videos = _videos(spark, folder)
    return distinct_videos(videos.unionAll(videos)).select(
        "channel_id", "video_id", "title", F.unix_timestamp("publish_time").alias("published")
    )


def captions_by_language(spark: SparkSession, folder: str) -> DataFrame:
    captions = nest_captions(
        _captions(spark, folder), ["video_id", "language"], STRETCH_TURNS
    )
    return captions_in_language(captions, "assistant").select(
        "video_id",
        F.size("transcript").cast("bigint").alias("n_captions"),
        F.array_join("transcript.text", "|").alias("texts"),
    )


def video_transcripts_query(spark: SparkSession, folder: str) -> DataFrame:
    return _transcripts(spark, folder).select(
        "video.channel_id",
        "video.video_id",
        "video.title",
        F.size("transcript").cast("bigint").alias("n_captions"),
        F.array_join("transcript.text", "|").alias("texts"),
    )


def missing_transcripts_query(spark: SparkSession, folder: str) -> DataFrame:
    captions = _nested_captions(spark, folder)
    return missing_transcripts(_videos(spark, folder), captions).select(
        "channel_id", "video_id", "title", "url"
    )


def caption_failures(spark: SparkSession, folder: str) -> DataFrame:
    """The reason of a missing transcript, landed for the documents in one language."""
    captions = _nested_captions(spark, folder)
    landed = captions.withColumn("error", F.lit(None).cast(FETCH_ERROR))
    cause = F.concat(F.lit("no captions of "), F.col("video_id"))
    failures = (
        _videos(spark, folder)
        .where("title = 'en'")
        .join(captions.select("video_id"), "video_id", "left_anti")
        .select(
            "video_id",
            F.lit(None).cast(landed.schema["transcript"].dataType).alias("transcript"),
            F.struct(F.lit("NotFound").alias("type"), cause.alias("cause")).alias("error"),
        )
    )
    landed = landed.select("video_id", "transcript", "error").unionByName(failures)
    return missing_transcripts(_videos(spark, folder), landed).select(
        "channel_id", "video_id", "title", "url", "error_type", "error_cause"
    )


def transcripts_flat(spark: SparkSession, folder: str) -> DataFrame:
    return flatten_transcripts(_transcripts(spark, folder)).select(
        "channel_id", "video_id", "title", "start", "text"
    )


def content(spark: SparkSession, folder: str) -> DataFrame:
    return transcript_content(_transcripts(spark, folder)).select(
        "channel_id", "video_id", "title", "content"
    )


def content_from_captions(spark: SparkSession, folder: str) -> DataFrame:
    return caption_text(_captions(spark, folder), ["video_id"], STRETCH_TURNS)


def content_from_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The content from captions that land in two drops: half of the videos and a shorter
    fetch of the others, then all in full. The second drop repeats what it need not."""
    name, path = _new_table(spark, "landed")
    spark.sql(f"CREATE DATABASE {name} LOCATION '{path}/tables'")
    params = CaptionsParams("test", name, channel_id="all", language="en")
    nested = materialised(_nested_captions(spark, folder))
    first = F.when(F.col("video_id").cast("long") % 2 == 0, F.col("transcript"))
    first = first.otherwise(F.slice("transcript", 1, 1)).alias("transcript")
    for drop in (nested.select("video_id", first), nested):
        landed = drop.select(
            "video_id",
            F.lit("en").alias("language"),
            "transcript",
            F.lit(None).cast(LANDED_CAPTIONS["error"].dataType).alias("error"),
        )
        landed.write.mode("append").json(f"{path}/landed")
        stream = caption_stream(spark, f"{path}/landed")
        query = land_captions(params, stream, lambda s: _videos(s, folder), f"{path}/state")
        query.awaitTermination()
    return spark.table(f"{name}.content").select("channel_id", "video_id", "title", "content")


def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _content(spark, folder).select(
        "video_id", pretoken_count(F.col("content")).cast("bigint").alias("n_tokens")
    )


def chunks_words(spark: SparkSession, folder: str) -> DataFrame:
    return _passages(spark, folder).select("id", "channel_id", "video_id", "title", "content")


def chunks_tokens(spark: SparkSession, folder: str) -> DataFrame:
    chunks = chunk_content(_content(spark, folder), CHUNK_SIZE, CHUNK_OVERLAP)
    return chunks.select("id", "channel_id", "video_id", "title", "content")


def chunks_tokens_large(spark: SparkSession, folder: str) -> DataFrame:
    """At the default size and overlap."""
    return chunk_content(_content(spark, folder)).select("id", "content")


def chunks_tokens_small(spark: SparkSession, folder: str) -> DataFrame:
    """So small that words are split at line ends and into characters."""
    return chunk_content(_content(spark, folder), 10, 2).select("id", "content")


def _long_vectors(vectors: DataFrame) -> DataFrame:
    return (
        vectors.select("id", F.posexplode("embedding").alias("bucket", "weight"))
        .where("weight <> 0")
        .select(
            "id",
            F.col("bucket").cast("bigint").alias("bucket"),
            F.round(F.col("weight").cast("double"), 6).alias("weight"),
        )
    )


def chunk_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return _long_vectors(_vectors(spark, folder))


def chunk_vectors_udf(spark: SparkSession, folder: str) -> DataFrame:
    """The same vectors from a Python model in calls of at most 150 texts."""
    return _long_vectors(add_embedding(_passages(spark, folder), lambda: lexical_model(DIM)))


def _refusing_model():
    """A model that refuses texts with a certain word."""
    embed = lexical_model(DIM)

    def model(texts):
        if any(REFUSED in text for text in texts):
            raise ValueError(REFUSED)
        return embed(texts)

    return model


def failed_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without a vector, as the model refuses them."""
    texts = spread(_table(spark, folder, "documents").select("doc_id", "text"))
    embedded = add_embedding(texts, lambda: _refusing_model(), "text", retry_one_by_one=True)
    return failed_embeddings(embedded).select("doc_id")


def _hits(hits: DataFrame) -> DataFrame:
    return hits.select(
        "query_id",
        "id",
        F.round("distance", 6).alias("distance"),
        F.col("rank").cast("bigint").alias("rank"),
    )


def _vector_table(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    vectors = _table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vectors.withColumnRenamed("id", "query_id"), vectors


def knn_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector against all vectors, the questions at every task."""
    questions, vectors = _vector_table(spark, folder)
    return _hits(nearest_passages(questions, spread(vectors), K))


def knn_ivf(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the questions in four blocks, the way for too many at once."""
    questions, vectors = _vector_table(spark, folder)
    limit = questions.count() * (8 * DIM + 64 * K) // 4 + 1
    return _hits(nearest_passages(questions, spread(vectors), K, broadcast_bytes=limit))


def knn_stored_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The same by cells that were fitted, written and read again."""
    questions, vectors = _vector_table(spark, folder)
    use_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/cells_{uuid4().hex}"
    write_cells(fit_cells(vectors, DIM), path)
    return _hits(nearest_passages(questions, vectors, K, cells=read_cells(spark, path)))


def _hundredth(vectors: DataFrame) -> DataFrame:
    """The questions of a search among all vectors: those with an id divisible by 100."""
    return vectors.where("id % 100 = 0").withColumnRenamed("id", "query_id")


def knn_join(spark: SparkSession, folder: str) -> DataFrame:
    """One vector in a hundred against all, both sides dealt into blocks."""
    _, vectors = _vector_table(spark, folder)
    return _hits(join_nearest(_hundredth(vectors), vectors, DIM, K))


def _stored_codes(spark: SparkSession, vectors: DataFrame):
    use_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/codes_{uuid4().hex}"
    write_codes(fit_codes(fit_cells(vectors, DIM)), path)
    return read_codes(spark, path)


def knn_codes(spark: SparkSession, folder: str) -> DataFrame:
    """One vector in a hundred against the codes of all, in all cells, 40 candidates a result."""
    _, vectors = _vector_table(spark, folder)
    codes = _stored_codes(spark, vectors)
    found = search_codes(_hundredth(vectors), codes, K, len(codes.cells.centers), 40)
    return _hits(found)


def _recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``n_questions``, whether nine tenths of the exact results are found, and whether
    those that are found have the exact distances."""
    exact = exact.select("query_id", "id", F.col("distance").alias("exact"))
    same = F.bool_and(F.col("distance") == F.col("exact"))
    return exact.join(found, ["query_id", "id"], "left").agg(
        F.count_distinct("query_id").alias("n_questions"),
        (F.count("distance") / F.count("*") >= 0.9).alias("recall_reached"),
        F.coalesce(same, F.lit(False)).alias("exact_distances"),
    )


def knn_codes_recall(spark: SparkSession, folder: str) -> DataFrame:
    """The same in three quarters of the cells, held against the exact results.

    The test vectors have no structure, so that neighbours lie in any cell."""
    _, vectors = _vector_table(spark, folder)
    questions = _hundredth(vectors)
    codes = _stored_codes(spark, vectors)
    found = search_codes(questions, codes, K, -(-3 * len(codes.cells.centers) // 4), 20)
    return _recall(found, nearest_passages(questions, spread(vectors), K))


def knn_close(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors so close that their distances agree in the first six decimals."""
    _, vectors = _vector_table(spark, folder)
    close = F.transform("embedding", lambda x: (x.cast("double") * 1e-4).cast("float"))
    vectors = vectors.withColumn("embedding", close)
    return _hits(nearest_passages(vectors.withColumnRenamed("id", "query_id"), spread(vectors), K))


def knn_odd_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """One vector in ten has one number, one is null, one has a number that is missing."""
    _, vectors = _vector_table(spark, folder)
    kind = F.col("id") % 10
    odd = (
        F.when(kind == 0, F.slice("embedding", 1, 1))
        .when(kind == 1, F.lit(None))
        .when(kind == 2, F.concat(F.slice("embedding", 1, 63), F.array(F.lit("NaN").cast("float"))))
        .otherwise(F.col("embedding"))
    )
    vectors = vectors.withColumn("embedding", odd)
    questions = vectors.withColumnRenamed("id", "query_id").orderBy("query_id")
    return _hits(nearest_passages(questions, spread(vectors), K))


def question_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    return _hits(nearest_passages(_questions(spark, folder), _vectors(spark, folder), K))


def _retrieved(spark: SparkSession, folder: str) -> DataFrame:
    hits = nearest_passages(_questions(spark, folder), _vectors(spark, folder), K)
    return retrieved(hits, _passages(spark, folder), FIELDS)


def retrieved_context(spark: SparkSession, folder: str) -> DataFrame:
    rows = _retrieved(spark, folder)
    return rows.select("query_id", F.col("rank").cast("bigint").alias("rank"), *FIELDS)


def context_repeated_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Passages beside a later copy of each, which is the one that counts."""
    vectors = stored(_vectors(spark, folder).select(*FIELDS, "embedding"))
    first = vectors.withColumn("version", F.lit(0))
    later = first.withColumn("content", F.concat("content", F.lit(LATER)))
    passages = first.unionByName(later.withColumn("version", F.lit(1)))
    hits = nearest_passages(
        _questions(spark, folder), last_of_repeated(passages, ["version"]), K
    )
    rows = retrieved(hits, passages, FIELDS, ["version"])
    return rows.select("query_id", F.col("rank").cast("bigint").alias("rank"), *FIELDS)


def context_cells_repeated(spark: SparkSession, folder: str) -> DataFrame:
    """The same by cells; passages in one language have later copies, with another vector."""
    first = _vectors(spark, folder).select(*FIELDS, "embedding")
    later = first.where("title = 'fr'").withColumns(
        {"content": F.concat("content", F.lit(LATER)), "embedding": F.reverse("embedding")}
    )
    passages = first.withColumn("version", F.lit(0)).unionByName(later.withColumn("version", F.lit(1)))
    cells = fit_cells(passages.select("id", "embedding", "version"), DIM, last_by=["version"])
    hits = nearest_passages(_questions(spark, folder), passages, K, cells=cells)
    rows = retrieved(hits, passages, FIELDS, ["version"])
    return rows.select("query_id", F.col("rank").cast("bigint").alias("rank"), *FIELDS)


DOCUMENT_ROWS = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("lang", StringType()),
        StructField("source", StringType()),
        StructField("n_chars", LongType()),
    ]
)


def _new_table(spark: SparkSession, kind: str) -> tuple[str, str]:
    """A name, and a folder for the data that all executors share."""
    use_checkpoints(spark)
    name = f"{kind}_{uuid4().hex}"
    return name, f"{spark.sparkContext.getCheckpointDir()}/{name}"


def table_overwrite(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in a table by language, of which one language is written again, altered."""
    name, path = _new_table(spark, "overwritten")
    docs = _table(spark, folder, "documents").select("lang", "doc_id", "source", "n_chars")
    write_table(spark, docs, DOCUMENT_ROWS, name, partition_cols=["lang"], path=path)
    altered = docs.where("lang = 'fr' AND n_chars > 500").withColumn("n_chars", F.col("n_chars") + 1)
    write_table(spark, altered, DOCUMENT_ROWS, name, partition_cols=["lang"], path=path)
    return spark.table(name).select("doc_id", "lang", "source", "n_chars")


def table_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in a table by language, of which some change, some move to another
    language, and some are new."""
    name, path = _new_table(spark, "upserted")
    docs = _table(spark, folder, "documents").select("lang", "doc_id", "source", "n_chars")
    where = {"keys": ["doc_id"], "partition_cols": ["lang"], "path": path}
    upsert_table(spark, docs, DOCUMENT_ROWS, name, **where)
    longer = docs.where("lang = 'fr' AND n_chars > 500").withColumn("n_chars", F.col("n_chars") + 1)
    moved = docs.where("lang = 'fr' AND n_chars < 300").withColumn("lang", F.lit("de"))
    new = docs.where("lang = 'de'").withColumn("doc_id", -1 - F.col("doc_id"))
    upsert_table(spark, longer.unionByName(moved).unionByName(new), DOCUMENT_ROWS, name, **where)
    return spark.table(name).select("doc_id", "lang", "source", "n_chars")


def table_by_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in a table of another format than the usual one, read by catalog and database."""
    name, path = _new_table(spark, "named")
    docs = _table(spark, folder, "documents")
    write_table(spark, docs, DOCUMENT_ROWS, f"default.{name}", path=path, fmt="orc")
    return read_table(spark, name, "default", "spark_catalog")


def _prompts(spark: SparkSession, folder: str) -> DataFrame:
    found = contexts(_retrieved(spark, folder), FIELDS)
    return prompts(_questions(spark, folder), found)


def rag_prompts(spark: SparkSession, folder: str) -> DataFrame:
    return _prompts(spark, folder).select("query_id", "input", "prompt")


def _stub_model():
    """Stands for a chat model: answers with the length of the prompt."""
    return lambda texts: [f"{len(text)} characters" for text in texts]


def rag_answers(spark: SparkSession, folder: str) -> DataFrame:
    answered = add_answer(_prompts(spark, folder), lambda: _stub_model())
    return answered.select(
        "query_id",
        "input",
        F.size("context").cast("bigint").alias("n_context"),
        F.array_join("context.id", ",").alias("context_ids"),
        "answer",
    )


def frame_diff_query(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without their number, compared with a copy whose lengths were
    altered for one source."""
    left = _table(spark, folder, "documents").select(
        "lang", "source", (F.col("n_chars") / 7.0).alias("length")
    )
    altered = F.when(F.col("source") == "src1", F.col("length") + 1).otherwise(
        F.col("length")
    )
    return frame_diff(left, left.withColumn("length", altered), digits=2).select(
        "lang", "source", "length", "side", F.col("copies").cast("bigint").alias("copies")
    )


def keyed_diff_query(spark: SparkSession, folder: str) -> DataFrame:
    """Documents compared with a copy in which those of one source and language have
    other lengths, and of which short ones are gone."""
    left = _table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    altered = (F.col("source") == "src1") & (F.col("lang") == "fr")
    right = left.withColumn("n_chars", F.when(altered, -F.col("n_chars")).otherwise(F.col("n_chars")))
    found = keyed_diff(left, right.where("n_chars < 0 OR n_chars > 100"), ["doc_id"])
    return found.withColumn("copies", F.col("copies").cast("bigint"))


def _with_nulls(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "documents").select(
        F.nullif("lang", F.lit("en")).alias("lang"), "source", "doc_id"
    )


def sorted_nulls_last(spark: SparkSession, folder: str) -> DataFrame:
    return sort_nulls_last(_with_nulls(spark, folder))


def row_index(spark: SparkSession, folder: str) -> DataFrame:
    return with_row_index(_with_nulls(spark, folder))


QUERIES = {
    "channel_listing": channel_listing,
    "videos_distinct": videos_distinct,
    "captions_by_language": captions_by_language,
    "video_transcripts": video_transcripts_query,
    "missing_transcripts": missing_transcripts_query,
    "caption_failures": caption_failures,
    "transcripts_flat": transcripts_flat,
    "content": content,
    "content_from_captions": content_from_captions,
    "content_from_stream": content_from_stream,
    "token_counts": token_counts,
    "chunks_words": chunks_words,
    "chunks_tokens": chunks_tokens,
    "chunks_tokens_large": chunks_tokens_large,
    "chunks_tokens_small": chunks_tokens_small,
    "chunk_vectors": chunk_vectors,
    "chunk_vectors_udf": chunk_vectors_udf,
    "failed_texts": failed_texts,
    "knn_exact": knn_exact,
    "knn_ivf": knn_ivf,
    "knn_stored_cells": knn_stored_cells,
    "knn_join": knn_join,
    "knn_codes": knn_codes,
    "knn_codes_recall": knn_codes_recall,
    "knn_close": knn_close,
    "knn_odd_vectors": knn_odd_vectors,
    "question_retrieval": question_retrieval,
    "retrieved_context": retrieved_context,
    "context_repeated_ids": context_repeated_ids,
    "context_cells_repeated": context_cells_repeated,
    "table_overwrite": table_overwrite,
    "table_upsert": table_upsert,
    "table_by_catalog": table_by_catalog,
    "rag_prompts": rag_prompts,
    "rag_answers": rag_answers,
    "frame_diff": frame_diff_query,
    "keyed_diff": keyed_diff_query,
    "sorted_nulls_last": sorted_nulls_last,
    "row_index": row_index,
}
