"""Landed files: playlist pages and captions fetched outside Spark."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passages.functions.text import (
    UPLOADS_PLAYLIST_PREFIX,
    playlist_id,
    published_at,
)
from passages.schemas import LANDED_CAPTIONS, PLAYLIST_PAGE


def read_playlist_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages as landed; a line that is not JSON of that form is an error."""
    return spark.read.schema(PLAYLIST_PAGE).json(path, mode="FAILFAST")


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """Captions as landed; a line that is not JSON of that form is an error."""
    return spark.read.schema(LANDED_CAPTIONS).json(path, mode="FAILFAST")


def _listings(pages: DataFrame) -> DataFrame:
    """``playlist_id, gone, problem``: what is wrong with the landed pages of a playlist.

    ``gone``: all that was landed is an error 404.
    """
    status = F.col("error.status_code")
    items = F.coalesce(F.size("items") > 0, F.lit(False))
    by_playlist = pages.groupBy("playlist_id").agg(
        F.max(F.coalesce(status == 404, F.lit(False))).alias("lost"),
        F.max(F.when(F.col("error").isNotNull() & ~status.eqNullSafe(404), F.coalesce(status, F.lit(-1)))).alias("failed"),
        F.max(items).alias("filled"),
        # As many tokens as a playlist has pages.
        F.array_sort(
            F.array_except(F.collect_set("nextPageToken"), F.collect_set("pageToken"))
        ).alias("absent"),
        F.max(F.col("pageToken").isNull()).alias("begun"),
    )
    absent = F.concat(F.lit("no page landed for token "), F.element_at("absent", 1))
    problem = (
        F.when(F.col("failed").isNotNull(), F.concat(F.lit("error "), F.col("failed").cast("string")))
        .when(F.col("lost") & F.col("filled"), F.lit("error 404 beside pages with items"))
        .when(~F.col("begun"), F.lit("no first page landed"))
        .when(F.size("absent") > 0, absent)
    )
    return by_playlist.select(
        "playlist_id", (F.col("lost") & ~F.col("filled")).alias("gone"), problem.alias("problem")
    )


def channel_videos(pages: DataFrame, channels: DataFrame) -> DataFrame:
    """Videos of each channel in ``channels(channel_id)``.

    A channel is listed from its "videos" playlist, or from "uploads" where the
    former was answered with error 404 and nothing else. The job fails on any other
    error, on a 404 beside pages with items, where a page that another one names as the
    next was not landed, and on a channel without pages; a page without items adds
    nothing. Rows equal in every field appear once.
    """
    listings = _listings(pages)
    gone = listings.where("gone").select("playlist_id", "gone")
    uploads = playlist_id(F.col("channel_id"), UPLOADS_PLAYLIST_PREFIX)
    chosen = (
        channels.select("channel_id")
        .distinct()
        .withColumn("playlist_id", playlist_id(F.col("channel_id")))
        .join(gone, "playlist_id", "left")
        .select(
            "channel_id",
            F.when(F.col("gone"), uploads).otherwise(F.col("playlist_id")).alias("playlist_id"),
        )
    )
    problem = (
        F.when(F.col("gone").isNull(), F.lit("no page landed"))
        .when(F.col("gone"), F.lit("error 404"))
        .otherwise(F.col("problem"))
    )
    reason = F.concat(F.lit("Unable to list "), F.col("channel_id"), F.lit(": "), problem)
    # Outer joins, so that a channel without pages reaches the check.
    videos = (
        chosen.join(listings, "playlist_id", "left")
        .join(pages.select("playlist_id", "items"), "playlist_id", "left")
        .where(F.assert_true(problem.isNull(), reason).isNull())
        .select("channel_id", F.explode("items.snippet").alias("snippet"))
        .select(
            "channel_id",
            F.col("snippet.resourceId.videoId").alias("video_id"),
            "snippet.title",
            published_at(F.col("snippet.publishedAt")).alias("publish_time"),
        )
    )
    return distinct_videos(videos)


def distinct_videos(videos: DataFrame) -> DataFrame:
    """Rows equal in every column once; two titles of one video both stay."""
    return videos.dropDuplicates()


def captions_in_language(captions: DataFrame, language: str = "en") -> DataFrame:
    """Captions of one language, in the order in which they were landed."""
    return captions.where(F.col("language") == language)
