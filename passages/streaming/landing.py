"""Captions that keep landing: tables that grow with each drop of files, as one batch would fill them."""

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructType

from passages.operators.transcripts import (
    best_fetches,
    flatten_transcripts,
    transcript_content,
    video_transcripts,
)
from passages.params import CaptionsParams
from passages.schemas import CONTENT, LANDED_CAPTIONS, TRANSCRIPTS
from passages.sources.checkpoints import materialised
from passages.sources.landing import captions_in_language
from passages.sources.tables import qualified_name
from passages.sources.upsert import upsert_table

FETCHED = "fetched_captions"
# The longest fetch of every video, in parts by the video, so that a drop rewrites few of them.
FETCHED_CAPTIONS = StructType(
    [LANDED_CAPTIONS["video_id"], LANDED_CAPTIONS["transcript"]]
).add("part", IntegerType())
PARTS = 64
# How long a file may land after younger ones for its copies to be told at once.
DELAY = "2 days"


def _name(params: CaptionsParams, table: str) -> str:
    return qualified_name(table, params.database, params.catalog)


def caption_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Captions as they land, with the time of their file as ``landed_at``; at most
    ``max_files`` files a batch. A line that is not JSON of that form is an error."""
    reader = spark.readStream.schema(LANDED_CAPTIONS).option("mode", "FAILFAST")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    time = F.col("_metadata.file_modification_time").alias("landed_at")
    return reader.json(path).select("*", time)


def new_captions(captions: DataFrame, language: str, delay: str = DELAY) -> DataFrame:
    """Fetches in one language that did not fail, each once however often it lands within
    ``delay``. The state holds a digest per fetch, and only of so long."""
    landed = captions_in_language(captions, language).where("error is null")
    digest = F.sha2(F.to_json(F.struct("transcript")), 256).alias("digest")
    return (
        landed.select("video_id", "transcript", "landed_at", digest)
        .withWatermark("landed_at", delay)
        .dropDuplicatesWithinWatermark(["video_id", "digest"])
        .select("video_id", "transcript")
    )


@contextmanager
def _adaptive(spark: SparkSession) -> Iterator[None]:
    """Adaptive execution, which a stream turns off in its session, for the batch jobs inside it:
    without it rows of a partition do not meet before a write, and every task writes files to all."""
    key = "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def add_captions(
    spark: SparkSession,
    params: CaptionsParams,
    videos: DataFrame,
    captions: DataFrame,
    parts: int = PARTS,
) -> None:
    """Put ``captions(video_id, transcript)`` into tables ``fetched_captions``, ``transcripts`` and ``content``.

    Of all fetches of a video so far the longest counts, then the greatest, whatever drop
    it came with; its rows replace those of a shorter one. So the tables do not depend on
    the order or the number of drops, and a drop that is applied again changes nothing. Only
    the parts, and the channels, of videos with new captions are rewritten: the last two
    tables are partitioned by channel. ``videos`` are those known now; captions of others
    wait in the first table until they are.
    """

    def name(table: str) -> str:
        return _name(params, table)

    part = F.pmod(F.xxhash64("video_id"), F.lit(parts)).cast("int").alias("part")
    fresh = materialised(captions.select("video_id", "transcript", part))
    # What the stream itself computes is planned without it, and done by now.
    with _adaptive(spark):
        stored = fresh.limit(0)
        if spark.catalog.tableExists(name(FETCHED)):
            reached = [row["part"] for row in fresh.select("part").distinct().collect()]  # of PARTS
            stored = spark.table(name(FETCHED)).where(F.col("part").isin(reached))
            stored = stored.join(fresh.select("video_id").distinct(), "video_id", "left_semi")
        best = best_fetches(fresh.unionByName(stored.select(*fresh.columns)))
        best = materialised(best.select("video_id", "transcript", part))
        fmt = params.table_format
        upsert_table(
            spark, best, FETCHED_CAPTIONS, name(FETCHED), ["part", "video_id"], ["part"], fmt=fmt
        )
        of_known = materialised(video_transcripts(videos, best))
        for rows, schema, table in (
            (flatten_transcripts(of_known), TRANSCRIPTS, "transcripts"),
            (transcript_content(of_known), CONTENT, "content"),
        ):
            keys = ["channel_id", "video_id"]
            upsert_table(spark, rows, schema, name(table), keys, ["channel_id"], fmt=fmt)


def land_captions(
    params: CaptionsParams,
    captions: DataFrame,
    videos: Callable[[SparkSession], DataFrame],
    checkpoint: str,
    delay: str = DELAY,
    parts: int = PARTS,
) -> StreamingQuery:
    """Run ``add_captions`` on what a ``caption_stream`` holds now, batch by batch, and stop.

    ``videos(session)`` reads the known videos anew for each batch. ``checkpoint`` keeps
    which files were seen and the state; it must lie where all executors can reach it. A batch
    that was cut off is run again, which changes nothing twice.
    """

    # A stream has a session of its own, whose writes the caller's does not notice.
    caller = captions.sparkSession

    def write(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        add_captions(session, params, videos(session), batch, parts)
        for table in (FETCHED, "transcripts", "content"):
            caller.catalog.refreshTable(_name(params, table))

    fresh = new_captions(captions, params.language, delay)
    return (
        fresh.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
