import json
from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from passages.functions.text import passage_id, playlist_id, published_at, watch_url
from passages.operators.transcripts import (
    caption_text,
    flatten_transcripts,
    missing_transcripts,
    nest_captions,
    transcript_content,
    video_transcripts,
)
from passages.schemas import CONTENT, LANDED_CAPTIONS, TRANSCRIPTS, VIDEO, VIDEO_TRANSCRIPT
from passages.sources.landing import (
    captions_in_language,
    channel_videos,
    distinct_videos,
    read_captions,
    read_playlist_pages,
)

TIME = datetime(2024, 8, 9, 16, 3, 23)


def _item(video, title="t", time="2024-08-09T16:03:23Z"):
    return {"snippet": {"title": title, "publishedAt": time, "resourceId": {"videoId": video}}}


def _land(spark, folder, rows, read):
    (folder / "landed.json").write_text("\n".join(json.dumps(r) for r in rows))
    return read(spark, str(folder))


def _channels(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "channel_id string")


def test_listing_over_pages(spark, tmp_path):
    pages = _land(
        spark,
        tmp_path,
        [
            {"playlist_id": "UULFabc", "items": [_item("v1")], "nextPageToken": "p2"},
            {"playlist_id": "UULFabc", "pageToken": "p2", "nextPageToken": "p3"},
            {"playlist_id": "UULFabc", "pageToken": "p3", "items": [_item("v2"), _item("v1")]},
            {"playlist_id": "UULFother", "items": [_item("v9")]},
            {"playlist_id": "UUabc", "items": [_item("short")]},
        ],
        read_playlist_pages,
    )
    videos = channel_videos(pages, _channels(spark, "UCabc"))
    assert videos.schema.fieldNames() == VIDEO.fieldNames()
    assert sorted(map(tuple, videos.collect())) == [
        ("UCabc", "v1", "t", TIME),
        ("UCabc", "v2", "t", TIME),
    ]


def test_listing_falls_back_to_uploads_after_404(spark, tmp_path):
    missing = {"playlist_id": "UULFabc", "error": {"status_code": 404}}
    pages = _land(
        spark,
        tmp_path,
        [missing, missing, {"playlist_id": "UUabc", "items": [_item("v1")]}],
        read_playlist_pages,
    )
    assert [r["video_id"] for r in channel_videos(pages, _channels(spark, "UCabc")).collect()] == [
        "v1"
    ]


@pytest.mark.parametrize(
    "rows",
    [
        [{"playlist_id": "UULFabc", "error": {"status_code": 500}}],
        [
            {"playlist_id": "UULFabc", "error": {"status_code": 404}},
            {"playlist_id": "UUabc", "error": {"status_code": 404}},
        ],
        [
            {"playlist_id": "UULFabc", "items": [_item("v1")], "nextPageToken": "p2"},
            {"playlist_id": "UULFabc", "error": {"status_code": 403}},
        ],
    ],
)
def test_listing_fails_on_other_errors(spark, tmp_path, rows):
    pages = _land(spark, tmp_path, rows, read_playlist_pages)
    with pytest.raises(PySparkException, match="Unable to list UCabc"):
        channel_videos(pages, _channels(spark, "UCabc")).collect()


@pytest.mark.parametrize(
    ("rows", "reason"),
    [
        (
            [
                {"playlist_id": "UULFabc", "items": [_item("v1")], "nextPageToken": "p2"},
                {"playlist_id": "UULFabc", "pageToken": "p2", "error": {"status_code": 404}},
            ],
            "404 beside pages",
        ),
        ([{"playlist_id": "UULFabc", "items": [_item("v1")], "nextPageToken": "p2"}], "token p2"),
        ([{"playlist_id": "UULFabc", "items": [_item("v1")], "pageToken": "p2"}], "no first page"),
        ([{"playlist_id": "UULFother", "items": [_item("v1")]}], "no page landed"),
    ],
)
def test_incomplete_listings_fail(spark, tmp_path, rows, reason):
    pages = _land(spark, tmp_path, rows, read_playlist_pages)
    with pytest.raises(PySparkException, match=f"Unable to list UCabc: .*{reason}"):
        channel_videos(pages, _channels(spark, "UCabc")).collect()


def test_broken_lines_fail(spark, tmp_path):
    (tmp_path / "landed.json").write_text('{"playlist_id": "UULFabc", "items": [\n')
    for read in (read_playlist_pages, read_captions):
        with pytest.raises(Exception, match="MALFORMED_RECORD"):
            read(spark, str(tmp_path)).collect()


def test_errors_of_other_channels_do_not_matter(spark, tmp_path):
    pages = _land(
        spark,
        tmp_path,
        [
            {"playlist_id": "UULFabc", "items": [_item("v1")]},
            {"playlist_id": "UULFxyz", "error": {"status_code": 500}},
        ],
        read_playlist_pages,
    )
    assert channel_videos(pages, _channels(spark, "UCabc")).count() == 1


def test_bad_time_is_an_error(spark, tmp_path):
    pages = _land(
        spark,
        tmp_path,
        [{"playlist_id": "UULFabc", "items": [_item("v1", time="soon")]}],
        read_playlist_pages,
    )
    with pytest.raises(PySparkException, match="not a time: soon"):
        channel_videos(pages, _channels(spark, "UCabc")).collect()


def test_times_with_an_offset(spark):
    df = spark.createDataFrame([("2024-08-09T18:03:23+02:00",), (None,)], "t string")
    assert [r[0] for r in df.select(published_at(F.col("t"))).collect()] == [TIME, None]


def test_videos_are_distinct_in_all_columns(spark):
    rows = [("c", "v", "old", TIME), ("c", "v", "new", TIME), ("c", "v", "new", TIME)]
    found = distinct_videos(spark.createDataFrame(rows, VIDEO)).collect()
    assert sorted(r["title"] for r in found) == ["new", "old"]


@pytest.fixture
def videos(spark):
    return spark.createDataFrame([("c", v, f"title {v}", TIME) for v in "abcd"], VIDEO)


@pytest.fixture
def captions(spark, tmp_path):
    said = [
        {"start": 9.5, "duration": 1.0, "text": "later"},
        {"start": 0.0, "duration": 2.0, "text": "first"},
    ]
    return _land(
        spark,
        tmp_path,
        [
            {"video_id": "a", "language": "en", "transcript": said},
            {"video_id": "a", "language": "pl", "transcript": said[:1]},
            {"video_id": "b", "language": "en", "transcript": []},
            {"video_id": "c", "language": "en", "transcript": None},
        ],
        read_captions,
    )


def test_captions_of_a_language_in_their_order(captions):
    found = {r["video_id"]: r["transcript"] for r in captions_in_language(captions).collect()}
    assert [c["text"] for c in found["a"]] == ["later", "first"]
    assert captions_in_language(captions, "pl").count() == 1
    assert captions.schema == LANDED_CAPTIONS


def test_transcripts(spark, videos, captions):
    transcripts = video_transcripts(videos, captions_in_language(captions))
    assert [f.dataType for f in transcripts.schema] == [f.dataType for f in VIDEO_TRANSCRIPT]
    flat = flatten_transcripts(transcripts)
    assert flat.schema.fieldNames() == TRANSCRIPTS.fieldNames()
    assert [tuple(r) for r in flat.orderBy("start").collect()] == [
        ("c", "a", "title a", TIME, 0.0, 2.0, "first"),
        ("c", "a", "title a", TIME, 9.5, 1.0, "later"),
    ]
    content = transcript_content(transcripts)
    assert content.schema.fieldNames() == CONTENT.fieldNames()
    assert {r["video_id"]: r["content"] for r in content.collect()} == {
        "a": "later first",
        "b": "",
        "c": "",
    }


def test_local_records_under_the_schema(spark):
    record = {
        "video": {"channel_id": "c", "video_id": "v", "title": "t", "publish_time": TIME},
        "transcript": [{"start": 0.5, "duration": 1.0, "text": "x"}],
    }
    assert [r["text"] for r in flatten_transcripts(
        spark.createDataFrame([record], VIDEO_TRANSCRIPT)
    ).collect()] == ["x"]


def test_missing_transcripts(videos, captions):
    (row,) = missing_transcripts(videos, captions_in_language(captions)).collect()
    assert row["video_id"] == "d"
    assert row["url"] == "https://www.youtube.com/watch?v=d"
    assert row["error_type"] is None and row["error_cause"] is None


def test_failed_and_repeated_landings(spark, videos, tmp_path):
    said = [{"start": float(i), "duration": 1.0, "text": f"t{i}"} for i in range(3)]
    failure = {"type": "TranscriptsDisabled", "cause": "by the owner"}
    captions = _land(
        spark,
        tmp_path,
        [
            {"video_id": "a", "language": "en", "transcript": said},
            {"video_id": "a", "language": "en", "transcript": said},
            {"video_id": "b", "language": "en", "transcript": said[:1]},
            {"video_id": "b", "language": "en", "transcript": said},
            {"video_id": "b", "language": "en", "error": failure},
            {"video_id": "d", "language": "en", "error": failure},
        ],
        read_captions,
    )
    spoken = captions_in_language(captions)
    content = transcript_content(video_transcripts(videos, spoken)).collect()
    assert {r["video_id"]: r["content"] for r in content} == {"a": "t0 t1 t2", "b": "t0 t1 t2"}
    assert len(content) == 2
    missing = {r["video_id"]: r for r in missing_transcripts(videos, spoken).collect()}
    assert missing.keys() == {"c", "d"}
    assert (missing["d"]["error_type"], missing["d"]["error_cause"]) == tuple(failure.values())
    assert missing["c"]["error_type"] is None


def test_gathering_over_many_stretches(spark):
    rows = [("v", float(i), 1.0, f"w{i}") for i in range(500)] + [("u", 3.0, 1.0, "x")]
    flat = spark.createDataFrame(
        rows, "video_id string, start double, duration double, text string"
    ).repartition(5, F.rand(1))
    expected = " ".join(f"w{i}" for i in range(500))
    text = {r["video_id"]: r["content"] for r in caption_text(flat, ["video_id"], 7.0).collect()}
    assert text == {"v": expected, "u": "x"}
    nested = nest_captions(flat, ["video_id"], 7.0).where("video_id = 'v'").first()
    assert [c["start"] for c in nested["transcript"]] == [float(i) for i in range(500)]


def test_scalars(spark):
    df = spark.createDataFrame([("UCabc", "v", 3), (None, "v", 4)], "c string, v string, i int")
    row, empty = df.select(
        playlist_id(F.col("c")).alias("p"),
        watch_url(F.col("v")).alias("u"),
        passage_id(F.col("c"), F.col("v"), F.col("i")).alias("id"),
    ).collect()
    assert tuple(row) == ("UULFabc", "https://www.youtube.com/watch?v=v", "UCabc_v_3")
    assert empty["id"] is None
