"""Declared schemas of the stored tables and of the landed files. All fields are nullable."""

from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    FloatType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


VIDEO = _struct(
    channel_id=StringType(),
    video_id=StringType(),
    title=StringType(),
    publish_time=TimestampType(),
)
CAPTION = _struct(start=DoubleType(), duration=DoubleType(), text=StringType())

# In-flight record: one row per video with its whole transcript.
VIDEO_TRANSCRIPT = _struct(video=VIDEO, transcript=ArrayType(CAPTION))

# Stored tables.
TRANSCRIPTS = StructType(VIDEO.fields + CAPTION.fields)
CONTENT = StructType(VIDEO.fields + _struct(content=StringType()).fields)
CONTENT_CHUNKS = StructType(_struct(id=StringType()).fields + CONTENT.fields)
CONTENT_CHUNKS_EMBEDDING = StructType(
    CONTENT_CHUNKS.fields + _struct(embedding=ArrayType(FloatType())).fields
)

# One row per question: the answer with the passages it was given, best first.
CONTEXT = _struct(
    id=StringType(),
    video_id=StringType(),
    title=StringType(),
    publish_time=TimestampType(),
    content=StringType(),
)
ANSWERS = _struct(
    query_id=StringType(), input=StringType(), answer=StringType(), context=ArrayType(CONTEXT)
)

# Landed playlist page: the answer as fetched, plus the playlist it was fetched for and the
# token it was asked for with; the first page has none.
PLAYLIST_PAGE = _struct(
    playlist_id=StringType(),
    pageToken=StringType(),
    items=ArrayType(
        _struct(
            snippet=_struct(
                title=StringType(),
                publishedAt=StringType(),
                resourceId=_struct(videoId=StringType()),
            )
        )
    ),
    nextPageToken=StringType(),
    error=_struct(status_code=IntegerType()),
)

# Landed captions: one row per fetch, in the order of the captions. A video with no captions
# at all (empty list) can be told from one whose fetch failed (with an error, or no row).
FETCH_ERROR = _struct(type=StringType(), cause=StringType())
LANDED_CAPTIONS = _struct(
    video_id=StringType(),
    language=StringType(),
    transcript=ArrayType(CAPTION),
    error=FETCH_ERROR,
)

# Audit of the videos without a transcript.
MISSING_TRANSCRIPTS = StructType(
    VIDEO.fields
    + _struct(url=StringType(), error_type=StringType(), error_cause=StringType()).fields
)
