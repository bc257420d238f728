"""Keys of groups of texts, counted over all groups by ranges of keys.

A group sends each range its distinct keys, packed; the range adds up what all groups
sent and answers each group with a bit, or a code, per key in the order sent. A key
that very many texts share is sent once per group, so no range is larger than others.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from passages.llm.packed import first_of_runs, mix

# A piece of a group's keys, and the answer to it. Kinds tell apart what is exchanged.
PIECES = "kind int, block long, g int, payload binary, extra binary"
ANSWERS = "g int, kind int, block long, payload binary"
EXACT = 9
# Rows of the count-min sketch.
DEPTH = 2
SEEDS = (0x8BB84B93962EACC9, 0x2D358DCCAA6C78A5)
# Keys of a range, about, and counters per key of a row of the sketch.
BLOCK_KEYS = 1 << 19
COUNTERS_PER_KEY = 8


def block_bits(keys: float) -> int:
    return max(0, int(np.ceil(np.log2(max(1.0, keys / BLOCK_KEYS)))))


def counter_bits(keys: float) -> int:
    return min(60, max(12, int(np.ceil(np.log2(max(2.0, keys * COUNTERS_PER_KEY))))))


def packed(array: np.ndarray) -> bytes:
    return pa.compress(array.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, dtype) -> np.ndarray:
    size = n * np.dtype(dtype).itemsize
    return np.frombuffer(pa.decompress(data, size, codec="zstd", asbytes=True), dtype)


def ranges(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """``block, from, to`` of sorted keys, by their highest bits."""
    if not bits:
        yield 0, 0, len(keys)
        return
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    cuts = [*np.searchsorted(keys, edges).tolist(), len(keys)]
    for block in range(1 << bits):
        if cuts[block] < cuts[block + 1]:
            yield block, cuts[block], cuts[block + 1]


def table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.table([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema)


PIECE_SCHEMA = pa.schema(
    [("kind", pa.int32()), ("block", pa.int64()), ("g", pa.int32()), ("payload", pa.binary()), ("extra", pa.binary())]
)
ANSWER_SCHEMA = pa.schema(
    [("g", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("payload", pa.binary())]
)


def counters(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The counter of each key in a row of the sketch, in the highest ``bits`` bits."""
    low = np.uint64(64 - bits)
    return (mix(keys ^ np.uint64(SEEDS[row])) >> low) << low


def sketch_pieces(g: int, keys: np.ndarray, bits: int, blocks: int) -> list[tuple]:
    """A group's part of the sketch: its counters that are not zero, as differences."""
    rows = []
    low = np.uint64(64 - bits)
    for row in range(DEPTH):
        found = np.sort(counters(keys, row, bits))
        at = np.flatnonzero(first_of_runs(found))
        counts = np.minimum(np.diff(np.append(at, len(found))), 255).astype(np.uint8)
        found = found[at]
        for block, low_end, high_end in ranges(found, blocks):
            own = found[low_end:high_end]
            steps = (np.diff(own, prepend=own[:1]) >> low).astype(np.uint32)
            head = np.array([len(own), own[0]], np.uint64).tobytes()
            own_counts = counts[low_end:high_end]
            more = packed(own_counts) if (own_counts > 1).any() else b""
            rows.append((row, block, g, head + packed(steps), more))
    return rows


def unpack_sketch(pieces: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Counters sent to a range, their values, and how many each piece holds."""
    sent, weights, sizes = [], [], []
    low = np.uint64(64 - bits)
    for payload, extra in zip(pieces["payload"].to_pylist(), pieces["extra"].to_pylist(), strict=True):
        n, first = np.frombuffer(payload[:16], np.uint64).tolist()
        steps = unpacked(payload[16:], n, np.uint32).astype(np.uint64) << low
        steps[0] = first
        sent.append(np.cumsum(steps))
        weights.append(unpacked(extra, n, np.uint8) if extra else np.ones(n, np.uint8))
        sizes.append(n)
    return np.concatenate(sent), np.concatenate(weights), sizes


def merge_sketch(pieces: pa.Table, bits: int) -> pa.Table:
    """Counters of one range, summed over groups; a bit per counter sent: is it over 1?"""
    sent, weights, sizes = unpack_sketch(pieces, bits)
    _, place = np.unique(sent, return_inverse=True)
    return _answers(pieces, (np.bincount(place, weights) > 1)[place], sizes)


def _answers(pieces: pa.Table, flags: np.ndarray, sizes: list[int]) -> pa.Table:
    rows, at = [], 0
    for g, kind, block, n in zip(
        pieces["g"].to_pylist(), pieces["kind"].to_pylist(), pieces["block"].to_pylist(), sizes, strict=True
    ):
        own = flags[at : at + n]
        at += n
        if own.any():
            rows.append((g, kind, block, np.packbits(own).tobytes()))
    return table(rows, ANSWER_SCHEMA)


def flagged(n: int, answers: dict[int, bytes], keys: np.ndarray, blocks: int) -> np.ndarray:
    """The answered bits of a group's sorted distinct keys."""
    flags = np.zeros(n, bool)
    for block, start, end in ranges(keys, blocks):
        if block in answers:
            bits = np.unpackbits(np.frombuffer(answers[block], np.uint8), count=end - start)
            flags[start:end] = bits.astype(bool)
    return flags


def by_kind(answers: pa.Table) -> dict[int, dict[int, bytes]]:
    found: dict[int, dict[int, bytes]] = {}
    for kind, block, payload in zip(
        answers["kind"].to_pylist(), answers["block"].to_pylist(), answers["payload"].to_pylist(), strict=True
    ):
        found.setdefault(kind, {})[block] = payload
    return found


def estimated_repeated(keys: np.ndarray, answers: dict, bits: int, blocks: int) -> np.ndarray:
    """Keys whose count is over 1 by the sketch: over 1 in each of its rows."""
    repeated = np.ones(len(keys), bool)
    for row in range(DEPTH):
        own = counters(keys, row, bits)
        distinct = np.sort(own)
        distinct = distinct[first_of_runs(distinct)]
        over = distinct[flagged(len(distinct), answers.get(row, {}), distinct, blocks)]
        if not len(over):
            return np.zeros(len(keys), bool)
        place = np.minimum(np.searchsorted(over, own), len(over) - 1)
        repeated &= over[place] == own
    return repeated


def distinct_pairs(first: np.ndarray, second: np.ndarray):
    """Distinct pairs in order, their counts, and the place of each pair among them."""
    order = np.lexsort((second, first))
    new = first_of_runs(first[order], second[order])
    at = np.flatnonzero(new)
    place = np.empty(len(first), np.int64)
    place[order] = np.cumsum(new) - 1
    counts = np.diff(np.append(at, len(first)))
    return first[order][at], second[order][at], counts, place


def exact_pieces(g: int, first: np.ndarray, second: np.ndarray, blocks: int) -> list[tuple]:
    """A group's distinct keys of 128 bits, and which of them it holds more than once."""
    one, two, counts, _ = distinct_pairs(first, second)
    return [
        (EXACT, block, g, one[a:b].tobytes() + two[a:b].tobytes(), np.packbits(counts[a:b] > 1).tobytes())
        for block, a, b in ranges(one, blocks)
    ]


def merge_exact(pieces: pa.Table) -> pa.Table:
    """A bit per key of 128 bits sent: does it occur more than once in all groups?"""
    one, two, many, sizes = [], [], [], []
    for payload, extra in zip(pieces["payload"].to_pylist(), pieces["extra"].to_pylist(), strict=True):
        both = np.frombuffer(payload, np.uint64)
        n = len(both) // 2
        one.append(both[:n])
        two.append(both[n:])
        many.append(np.unpackbits(np.frombuffer(extra, np.uint8), count=n))
        sizes.append(n)
    _, _, _, place = distinct_pairs(np.concatenate(one), np.concatenate(two))
    counts = np.bincount(place, 1 + np.concatenate(many))
    return _answers(pieces, (counts > 1)[place], sizes)


def exact_repeated(first: np.ndarray, second: np.ndarray, answers: dict, blocks: int) -> np.ndarray:
    if not len(first):
        return np.zeros(0, bool)
    one, _, _, place = distinct_pairs(first, second)
    return flagged(len(one), answers.get(EXACT, {}), one, blocks)[place]


def merged(pieces: DataFrame, bits: int) -> DataFrame:
    """Answers to all pieces of the sketch and of exact keys."""

    def merge(rows: pa.Table) -> pa.Table:
        return merge_exact(rows) if rows["kind"][0].as_py() == EXACT else merge_sketch(rows, bits)

    return pieces.groupBy("kind", "block").applyInArrow(merge, ANSWERS)
