"""``python -m passages.plans JOB --conf-file FILE``: run a job under spark-submit."""

import argparse
import importlib

from pyspark.sql import SparkSession

from passages.params import read_params
from passages.plans.jobs import answers_job, captions_job, chunk_job, embedding_job
from passages.sources.landing import read_captions, read_playlist_pages


def _load(reference: str):
    module, _, name = reference.partition(":")
    return getattr(importlib.import_module(module), name)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="passages")
    parser.add_argument("job", choices=["captions", "chunk", "embedding", "answers"])
    parser.add_argument("--conf-file", required=True)
    parser.add_argument("--pages", help="captions: landed playlist pages (JSON)")
    parser.add_argument("--captions", help="captions: landed captions (JSON)")
    parser.add_argument(
        "--model", help="embedding, answers: module:function, endpoint name to embedding model"
    )
    parser.add_argument(
        "--chat", help="answers: module:function, endpoint name, temperature, tokens to chat model"
    )
    parser.add_argument("--questions", help="answers: table with query_id and input")
    parser.add_argument("--format", default="deltaSharing", help="answers: of the vector table")
    parser.add_argument("--cells", help="answers: path of stored cells to search")
    parser.add_argument(
        "--first-cells", type=int, help="answers: stop after so many cells, approximately"
    )
    options = parser.parse_args(arguments)
    needed = {
        "captions": ("pages", "captions"),
        "embedding": ("model",),
        "answers": ("model", "chat", "questions"),
    }
    for name in needed.get(options.job, ()):
        if not getattr(options, name):
            parser.error(f"{options.job} needs --{name}")

    params = read_params(options.conf_file)
    spark = SparkSession.builder.getOrCreate()
    if options.job == "captions":
        pages = read_playlist_pages(spark, options.pages)
        landed = read_captions(spark, options.captions)
        missing = captions_job(spark, params.video_captions, pages, landed).count()
        print(f"{missing} videos without a transcript, see table missing_transcripts")
    elif options.job == "chunk":
        chunk_job(spark, params.chunk)
    elif options.job == "embedding":
        embedding_job(spark, params.embedding, _load(options.model))
    else:
        questions = spark.read.table(options.questions)
        embedder, chat = _load(options.model), _load(options.chat)
        search = {}
        if options.first_cells is not None:
            search = {"first_cells": options.first_cells, "complete": False}
        answers_job(
            spark, params, questions, embedder, chat, options.format, options.cells, **search
        )


if __name__ == "__main__":
    main()
