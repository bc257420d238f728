"""Videos and captions to transcripts and text."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passages.functions.text import join_text, watch_url
from passages.schemas import FETCH_ERROR

VIDEO_COLUMNS = ("channel_id", "video_id", "title", "publish_time")

# Captions are gathered in two steps, first per stretch of this many seconds and
# then per video, so that the captions of one very long recording are sorted and
# joined by many tasks and the last step only strings finished stretches together.
STRETCH_SECONDS = 3600.0


def _stretch(start: Column, seconds: float) -> Column:
    return F.floor(start / F.lit(seconds))


def _gather(captions: DataFrame, keys: list[str], seconds: float, finish) -> DataFrame:
    """Per key and stretch, in order: ``keys, parts`` with ``finish(sorted captions)``."""
    caption = F.struct("start", "duration", "text")
    return (
        captions.groupBy(*keys, _stretch(F.col("start"), seconds).alias("stretch"))
        .agg(finish(F.array_sort(F.collect_list(caption))).alias("part"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("stretch", "part"))).alias("parts"))
    )


def nest_captions(
    captions: DataFrame, keys: list[str], seconds: float = STRETCH_SECONDS
) -> DataFrame:
    """Flat captions ``keys, start, duration, text`` to ``keys, transcript`` in time order."""
    gathered = _gather(captions, keys, seconds, lambda sorted_captions: sorted_captions)
    return gathered.select(*keys, F.flatten("parts.part").alias("transcript"))


def caption_text(
    captions: DataFrame, keys: list[str], seconds: float = STRETCH_SECONDS
) -> DataFrame:
    """Flat captions to ``keys, content``: the texts in time order, joined by a blank."""
    gathered = _gather(captions, keys, seconds, lambda sorted_captions: sorted_captions["text"])
    return gathered.select(*keys, join_text(F.flatten("parts.part")).alias("content"))


def best_fetches(captions: DataFrame) -> DataFrame:
    """``video_id, transcript`` of the fetches that did not fail, one row per video.

    Of several landings of a video, the one with most captions counts, then the greatest.
    """
    if "error" in captions.columns:
        captions = captions.where("error is null")
    best = F.max(F.struct(F.size("transcript").alias("size"), "transcript")).alias("best")
    return captions.groupBy("video_id").agg(best).select("video_id", "best.transcript")


def video_transcripts(videos: DataFrame, captions: DataFrame) -> DataFrame:
    """Videos with their captions ``video_id, transcript``; those without a row, or with a
    failed fetch only, are left out. Captions landed twice count once."""
    return videos.join(best_fetches(captions), "video_id").select(
        F.struct(*VIDEO_COLUMNS).alias("video"), "transcript"
    )


def missing_transcripts(videos: DataFrame, captions: DataFrame) -> DataFrame:
    """Videos that ``video_transcripts`` leaves out, with the link to look them up, and
    ``error_type, error_cause`` where a failed fetch was landed."""
    if "error" not in captions.columns:
        captions = captions.select("video_id", F.lit(None).cast(FETCH_ERROR).alias("error"))
    fetched = captions.where("error is null").select("video_id")
    failed = captions.where("error is not null").groupBy("video_id").agg(F.max("error").alias("error"))
    return (
        videos.join(fetched, "video_id", "left_anti")
        .join(failed, "video_id", "left")
        .select(
            *videos.columns,
            watch_url(F.col("video_id")).alias("url"),
            F.col("error.type").alias("error_type"),
            F.col("error.cause").alias("error_cause"),
        )
    )


def _video_columns() -> list[Column]:
    time = F.to_timestamp("video.publish_time").alias("publish_time")
    return [time if c == "publish_time" else F.col(f"video.{c}") for c in VIDEO_COLUMNS]


def flatten_transcripts(transcripts: DataFrame) -> DataFrame:
    """One row per caption; a video with an empty or null transcript has none."""
    return transcripts.select(
        *_video_columns(), F.explode("transcript").alias("caption")
    ).select(*VIDEO_COLUMNS, "caption.start", "caption.duration", "caption.text")


def transcript_content(transcripts: DataFrame) -> DataFrame:
    """One row per video with its text; an empty or null transcript gives an empty text."""
    return transcripts.select(
        *_video_columns(), join_text(F.col("transcript.text")).alias("content")
    )
