"""Text to overlapping passages of a limited number of tokens."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passages.functions.text import passage_id, pretoken_count, strip, words

# Fixed value: tokens of the chunk size set aside for the formatting of metadata,
# also where there is no metadata.
RESERVED_TOKENS = 2

# A piece of text starts at each blank (or line end) and keeps it in front.
_AT_BLANK = "(?= )"
_AT_LINE_END = "(?=\n)"
_AT_CHARACTER = ""


# The Python functions here are deterministic, but are declared otherwise: the optimizer
# would move a filter on their results below them and so evaluate them twice.


class PretokenCounter:
    """Counts pre-tokens with a built-in expression; text stays in the JVM."""

    def text(self, text: Column) -> Column:
        return pretoken_count(text)

    def pieces(self, pieces: Column) -> Column:
        return F.transform(pieces, pretoken_count)


class PythonCounter:
    """Counts with a Python tokenizer, made once per worker by ``make_tokenizer()``.

    The tokenizer takes a text and returns its tokens.
    """

    def __init__(self, make_tokenizer: Callable[[], Callable[[str], list]]):
        self.make_tokenizer = make_tokenizer

    def text(self, text: Column) -> Column:
        return self.pieces(F.when(text.isNotNull(), F.array(text)))[0]

    def pieces(self, pieces: Column) -> Column:
        make_tokenizer = self.make_tokenizer

        # The iterator form makes the tokenizer once per task, not once per batch.
        @F.arrow_udf("array<int>")
        def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            tokenizer = make_tokenizer()
            for batch in batches:
                yield pa.array(
                    [
                        None if row is None else [len(tokenizer(piece)) for piece in row]
                        for row in batch.to_pylist()
                    ],
                    pa.list_(pa.int32()),
                )

        return count.asNondeterministic()(pieces)


def _spans(counts: np.ndarray, size: int, overlap: int) -> tuple[list[int], list[int]]:
    """Start and length, in pieces, of each passage of one text.

    A passage takes pieces while their tokens fit ``size``. The next one begins
    with the last pieces of it that hold at most ``overlap`` tokens and leave room
    for the piece that did not fit.
    """
    total = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    starts, lengths = [], []
    start, n = 0, len(counts)
    while start < n:
        end = int(np.searchsorted(total, total[start] + size, side="right")) - 1
        starts.append(start)
        lengths.append(end - start)
        if end == n:
            break
        room = max(total[end] - overlap, total[end + 1] - size)
        following = max(start, int(np.searchsorted(total, room, side="left")))
        if following > end:
            raise ValueError(f"a single character has more than {size} tokens")
        start = following
    return starts, lengths


def _span_column(counts: Column, size: int, overlap: int) -> Column:
    @F.arrow_udf("array<struct<start:int,length:int>>")
    def spans(batch: pa.Array) -> pa.Array:
        bounds = batch.offsets.to_numpy()
        values = batch.values.to_numpy(zero_copy_only=False)
        valid = batch.is_valid().to_numpy(zero_copy_only=False)
        starts, lengths, offsets = [], [], [0]
        for i, known in enumerate(valid):
            if known:
                s, n = _spans(values[bounds[i] : bounds[i + 1]], size, overlap)
                starts += s
                lengths += n
            offsets.append(len(starts))
        found = pa.StructArray.from_arrays(
            [pa.array(starts, pa.int32()), pa.array(lengths, pa.int32())], ["start", "length"]
        )
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found)

    return spans.asNondeterministic()(counts)


def _split_long(pieces: Column, counts: Column, size: int, pattern: str) -> Column:
    """Pieces with those above ``size`` tokens split again; null if none is above."""
    split = F.flatten(
        F.zip_with(
            pieces,
            counts,
            lambda piece, n: F.when(n > size, F.split(piece, pattern)).otherwise(F.array(piece)),
        )
    )
    return F.when(F.array_max(counts) > size, split)


def token_passages(
    df: DataFrame,
    text: str = "content",
    chunk_size: int = 500,
    chunk_overlap: int = 50,
    counter=None,
    output: str = "passages",
) -> DataFrame:
    """Add the array of passages of each text.

    Splits at blanks; a piece that is still too long is split at line ends and then
    into characters. Pieces and their counts are built-in expressions, and only the
    counts go to Python, where the greedy grouping needs state along the text.
    """
    size = chunk_size - RESERVED_TOKENS
    if not 0 <= chunk_overlap < size:
        raise ValueError("chunk_overlap must be at least 0 and below chunk_size - 2")
    counter = counter or PretokenCounter()
    fits, pieces, counts, spans = (F.col(f"__{n}") for n in ("fits", "pieces", "counts", "spans"))

    # A text that fits as a whole is one piece, whatever its parts add up to.
    df = df.withColumn("__fits", counter.text(F.col(text)) <= size)
    df = df.withColumn("__pieces", F.when(~fits, F.split(text, _AT_BLANK)))
    df = df.withColumn("__counts", counter.pieces(pieces))
    for pattern in (_AT_LINE_END, _AT_CHARACTER):
        df = df.withColumn("__split", _split_long(pieces, counts, size, pattern))
        df = df.withColumn("__recount", counter.pieces(F.col("__split")))
        df = df.withColumns(
            {
                "__pieces": F.coalesce("__split", pieces),
                "__counts": F.coalesce("__recount", counts),
            }
        ).drop("__split", "__recount")
    df = df.withColumn("__spans", _span_column(counts, size, chunk_overlap))

    grouped = F.filter(
        F.transform(
            spans,
            lambda s: strip(F.array_join(F.slice(pieces, s["start"] + 1, s["length"]), "")),
        ),
        lambda passage: passage != "",
    )
    stripped = strip(F.col(text))
    single = F.when((F.col(text) != "") & (stripped == ""), F.array().cast("array<string>"))
    return df.withColumn(
        output,
        F.when(fits, single.otherwise(F.array(stripped))).when(F.col(text).isNotNull(), grouped),
    ).drop("__fits", "__pieces", "__counts", "__spans")


def word_passages(
    df: DataFrame,
    text: str = "content",
    chunk_size: int = 50,
    chunk_overlap: int = 5,
    output: str = "passages",
) -> DataFrame:
    """Add passages of ``chunk_size`` words, each repeating the last ``chunk_overlap``.

    The case in which every word is one token: the bounds are arithmetic, so this
    is built-in expressions only.
    """
    if not 0 <= chunk_overlap < chunk_size:
        raise ValueError("chunk_overlap must be at least 0 and below chunk_size")
    stride = chunk_size - chunk_overlap
    words_of = F.col("__words")
    more = F.ceil((F.size(words_of) - chunk_size) / F.lit(stride)).cast("int")
    starts = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), more)), lambda i: i * stride + 1
    )
    passages = F.transform(
        starts, lambda start: F.array_join(F.slice(words_of, start, chunk_size), " ")
    )
    return (
        df.withColumn("__words", words(F.col(text)))
        .withColumn(output, F.when(words_of.isNotNull(), passages))
        .drop("__words")
    )


def explode_passages(df: DataFrame, passages: str = "passages", text: str = "content") -> DataFrame:
    """One row per passage: the other columns, ``id`` and the passage as ``text``."""
    kept = [c for c in df.columns if c not in (passages, text)]
    # The inner form makes the optimizer add a filter on the array and push it below
    # the projections that build it, which then run twice; the outer form does not.
    return (
        df.select(*kept, F.posexplode_outer(passages).alias("index", text))
        .where(F.col("index").isNotNull())
        .withColumn("id", passage_id(F.col("channel_id"), F.col("video_id"), F.col("index")))
        .drop("index")
    )


def chunk_content(
    content: DataFrame, chunk_size: int = 500, chunk_overlap: int = 50, counter=None
) -> DataFrame:
    """``content`` rows to passage rows. A null text has no passage."""
    return explode_passages(
        token_passages(content, "content", chunk_size, chunk_overlap, counter)
    )


def chunk_words(content: DataFrame, chunk_size: int = 50, chunk_overlap: int = 5) -> DataFrame:
    return explode_passages(word_passages(content, "content", chunk_size, chunk_overlap))
