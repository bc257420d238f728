"""Repeated windows of words, found with a count-min sketch and confirmed exactly."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from passages.llm.exchange import (
    PIECE_SCHEMA,
    PIECES,
    block_bits,
    by_kind,
    counter_bits,
    estimated_repeated,
    exact_pieces,
    exact_repeated,
    merged,
    sketch_pieces,
    table,
)
from passages.llm.packed import BASE, OTHER_BASE, Flat, Hashes, flat, mix, within, word_hashes, word_spans
from passages.llm.shared import saved, text_groups

# Bytes of a word with the white space after it, about; sets the size of the sketch.
BYTES_PER_WORD = 6


@dataclass
class Words:
    """Words of a group of texts; text ``i`` has the words ``first[i]`` to ``last[i]``."""

    flat: Flat
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def hashes(self, base: int) -> np.ndarray:
        return word_hashes(self.flat.data, self.starts, self.ends, base)


def words_of(texts: list[bytes]) -> Words:
    text = flat(texts)
    starts, ends = word_spans(text.data)
    return Words(text, starts, ends, np.searchsorted(starts, text.starts), np.searchsorted(starts, text.ends))


def window_starts(words: Words, length: int) -> np.ndarray:
    """First words of the windows that lie within one text."""
    long = words.last - words.first >= length
    return np.flatnonzero(within(words.first[long], words.last[long] - length + 1, len(words.starts)))


def window_hashes(words: Words, length: int, at: np.ndarray, base: int) -> np.ndarray:
    return mix(Hashes(words.hashes(base), base).windows(length)[at]) if len(at) else np.zeros(0, np.uint64)


def kept_texts(words: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, with one blank between two."""
    starts, ends = words.starts[keep], words.ends[keep]
    counts = np.concatenate([[0], np.cumsum(keep)])
    first, last = counts[words.first], counts[words.last]
    steps = np.zeros(len(words.flat.data) + 1, np.int8)
    steps[starts] += 1
    steps[ends] -= 1
    include = np.cumsum(steps[:-1], dtype=np.int8).astype(bool)
    data = words.flat.data.copy()
    data[ends] = 32
    include[ends] = True
    include[ends[last[last > first] - 1]] = False
    before = np.concatenate([[0], np.cumsum(include)])
    offsets = np.append(before[words.flat.starts], before[-1]).astype(np.int32)
    return pa.StringArray.from_buffers(
        len(words.first), pa.py_buffer(offsets), pa.py_buffer(data[include].tobytes())
    )


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 35
) -> DataFrame:
    """``id, text, n_words, n_removed`` of every row of ``docs``: texts without repeats.

    Words are runs of characters other than U+0020 and U+0009 to U+000D. A window is
    ``length`` consecutive words of one text; a word goes when a window that covers it
    starts at least twice among all texts. Windows are judged on the input. ``text`` is
    what stays, with one blank between words.

    Three passes over texts that lie in buckets, so that texts move once. First, each
    group of texts sends its part of a count-min sketch of all its windows, as the
    counters that are not zero, to the ranges of counters; merged there, they count a
    window at least as often as it occurs, so none that repeats is lost. Each group is
    told which of its counters are over 1. Second, windows over 1 in every row of the
    sketch are counted exactly, by 128-bit hashes of their words. Third, words go. The
    sketch grows with the texts (eight counters per expected window and row), no task
    holds more than a range of it, and nothing passes through the driver.

    Null and empty texts have no words. A row repeated is a repeat of all its windows.
    Texts of fewer words than ``length`` stay. An empty table gives an empty result;
    other columns are left out.
    """
    groups = text_groups(docs, id_col, text_col)
    expected = groups.text_bytes / BYTES_PER_WORD
    bits, blocks = counter_bits(expected), block_bits(expected)
    exact_blocks = max(0, blocks - 1)

    def group_of(rows: pa.Table) -> tuple[int, Words, np.ndarray]:
        words = words_of(rows["text"].cast(pa.binary()).to_pylist())
        return rows["g"][0].as_py(), words, window_starts(words, length)

    def sketch(rows: pa.Table) -> pa.Table:
        g, words, at = group_of(rows)
        keys = window_hashes(words, length, at, BASE)
        return table(sketch_pieces(g, keys, bits, blocks) if len(keys) else [], PIECE_SCHEMA)

    def candidates(words: Words, at: np.ndarray, answers: dict):
        keys = window_hashes(words, length, at, BASE)
        likely = estimated_repeated(keys, answers, bits, blocks) if len(keys) else np.zeros(0, bool)
        at = at[likely]
        return at, keys[likely], window_hashes(words, length, at, OTHER_BASE)

    def confirm(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows or not answers.num_rows:
            return PIECE_SCHEMA.empty_table()
        g, words, at = group_of(rows)
        at, one, two = candidates(words, at, by_kind(answers))
        return table(exact_pieces(g, one, two, exact_blocks) if len(at) else [], PIECE_SCHEMA)

    def remove(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return result.empty_table()
        _, words, at = group_of(rows)
        known = by_kind(answers)
        at, one, two = candidates(words, at, known)
        at = at[exact_repeated(one, two, known, exact_blocks)]
        gone = within(at, at + length, len(words.starts))
        before = np.concatenate([[0], np.cumsum(gone)])
        return pa.table(
            [
                rows["id"],
                kept_texts(words, ~gone),
                pa.array(words.last - words.first, pa.int64()),
                pa.array(before[words.last] - before[words.first], pa.int64()),
            ],
            names=["id", "text", "n_words", "n_removed"],
        )

    by_group = groups.rows.groupBy("g")
    sketched = saved(merged(by_group.applyInArrow(sketch, PIECES), bits))
    pieces = by_group.cogroup(sketched.groupBy("g")).applyInArrow(confirm, PIECES)
    answers = saved(sketched.union(saved(merged(pieces, bits))))
    id_type = groups.rows.schema["id"].dataType
    result = pa.schema(
        [
            ("id", to_arrow_type(id_type)),
            ("text", pa.string()),
            ("n_words", pa.int64()),
            ("n_removed", pa.int64()),
        ]
    )
    return by_group.cogroup(answers.groupBy("g")).applyInArrow(
        remove, f"id {id_type.simpleString()}, text string, n_words long, n_removed long"
    )
