import json

import pytest

from pyspark.sql.types import StructType

from passages.params import CaptionsParams
from passages.plans.jobs import captions_job
from passages.sources.landing import channel_videos, read_captions, read_playlist_pages
from passages.streaming import landing
from passages.streaming.landing import add_captions, caption_stream, land_captions


def _said(*texts):
    return [{"start": float(i), "duration": 1.0, "text": t} for i, t in enumerate(texts)]


def _landed(video, *texts, language="en", error=None):
    return {
        "video_id": video,
        "language": language,
        "transcript": None if error else _said(*texts),
        "error": error,
    }


DROPS = [
    [_landed("a", "one"), _landed("b", "x", "y"), _landed("c", error={"type": "E", "cause": "gone"})],
    [
        _landed("a", "one", "two"),  # longer: takes the place of the first
        _landed("b", "x"),  # shorter: changes nothing
        _landed("b", "x", "y"),  # landed again
        _landed("c", "late"),
        _landed("d", "other", language="fr"),
        _landed("e"),  # an empty list is a fetch too
        _landed("stranger", "no such video"),
    ],
]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "captions").mkdir()
    (tmp_path / "pages").mkdir()
    items = [
        {"snippet": {"title": v, "publishedAt": "2024-08-09T16:03:23Z", "resourceId": {"videoId": v}}}
        for v in "abcdef"
    ]
    page = {"playlist_id": "UULFabc", "items": items}
    (tmp_path / "pages" / "1.json").write_text(json.dumps(page))
    return tmp_path


def _drop(folder, name, rows):
    (folder / "captions" / name).write_text("\n".join(json.dumps(r) for r in rows))


def _params(database):
    return CaptionsParams("test", database, channel_id="UCabc")


def _database(spark, name):
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")
    spark.sql(f"CREATE DATABASE {name}")
    return name


def _tables(spark, database):
    return {
        name: sorted(map(tuple, spark.table(f"{database}.{name}").select(
            *(c for c in ("channel_id", "video_id", "title", "start", "text", "content")
              if c in spark.table(f"{database}.{name}").columns)).collect()))
        for name in ("transcripts", "content")
    }


def _videos(folder):
    def read(session):
        pages = read_playlist_pages(session, str(folder / "pages"))
        return channel_videos(pages, session.createDataFrame([("UCabc",)], "channel_id string"))

    return read


def _run(spark, folder, database, state):
    stream = caption_stream(spark, str(folder / "captions"), max_files=1)
    query = land_captions(_params(database), stream, _videos(folder), str(folder / state), parts=4)
    query.awaitTermination()
    return query


def test_drops_give_the_tables_of_one_batch(spark, folder, monkeypatch):
    batch, stream = _database(spark, "whole_batch"), _database(spark, "by_stream")
    arrived = []
    inside = landing.add_captions

    def watched(session, params, videos, captions, parts):
        arrived.append(sorted(r["video_id"] for r in captions.collect()))
        inside(session, params, videos, captions, parts)

    monkeypatch.setattr(landing, "add_captions", watched)
    for number, rows in enumerate(DROPS):
        _drop(folder, f"{number}.json", rows)
        _run(spark, folder, stream, "state")
    pages = read_playlist_pages(spark, str(folder / "pages"))
    captions_job(spark, _params(batch), pages, read_captions(spark, str(folder / "captions")))
    wanted = _tables(spark, batch)
    assert [r[-1] for r in wanted["content"]] == ["one two", "x y", "late", ""]
    assert _tables(spark, stream) == wanted
    # What landed twice reached the tables once; the fetch that failed never did.
    assert [v for v in arrived if v] == [["a", "b"], ["a", "b", "c", "e", "stranger"]]
    # All drops once more, as after the loss of the stream's state.
    _run(spark, folder, stream, "other_state")
    assert _tables(spark, stream) == wanted
    # A video that becomes known later is filled in by any later fetch of it.
    known = spark.createDataFrame(
        [("UCabc", "stranger", "t", None)], "channel_id string, video_id string, title string, publish_time timestamp"
    )
    again = spark.createDataFrame([("stranger", _said("no such video"))], StructType(landing.FETCHED_CAPTIONS.fields[:2]))
    add_captions(spark, _params(stream), known, again, 4)
    assert ("UCabc", "stranger", "t", "no such video") in _tables(spark, stream)["content"]


def test_a_replayed_batch_changes_no_row(spark, folder):
    database = _database(spark, "replayed")
    read = _videos(folder)
    rows = [(r["video_id"], r["transcript"]) for r in DROPS[1] if r["language"] == "en" and r["transcript"] is not None]
    batch = spark.createDataFrame(rows, StructType(landing.FETCHED_CAPTIONS.fields[:2]))
    add_captions(spark, _params(database), read(spark), batch, 4)
    before = _tables(spark, database)
    add_captions(spark, _params(database), read(spark), batch, 4)
    add_captions(spark, _params(database), read(spark), batch.limit(0), 4)
    assert _tables(spark, database) == before


def test_a_drop_writes_few_files(spark, folder):
    database = _database(spark, "few_files")
    _drop(folder, "many.json", [_landed(f"v{n}", f"text {n}") for n in range(400)])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        _run(spark, folder, database, "state")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    stored = spark.table(f"{database}.{landing.FETCHED}")
    # One file per part, not one per part and task.
    assert stored.count() == 400 and len(stored.inputFiles()) == 4
