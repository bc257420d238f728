"""Pieces of documents packed into sequences by a configuration linear program.

A configuration is a multiset of lengths that fit into one sequence. The program asks for
the fewest configurations that cover the histogram of lengths. Multiplicative weights solve
it: a length's price falls as it gets covered, a knapsack by dynamic programming finds the
dearest configuration around each length, and those are taken a little more often. The
solution is rounded to whole configurations, the rest of the histogram is solved again, and
what is left in the end goes into sequences by best fit. All of this sees the histogram
only, which has as many entries as a sequence has tokens, whatever the number of documents.
"""

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from passages.llm.shared import saved
from passages.llm.tokens import Encoder
from passages.sources.spread import spread

CAPACITY = 1024
END = 2
# Rounds of weights per program, fall of a price per whole cover, share of the dearest
# configuration's price that counts as dearest, and cover that a round adds at most.
ROUNDS, FALL, NEAR, STEP = 60, 4.0, 0.02, 0.25
# Programs are solved until one takes less than this share of what was left.
LEAST_TAKEN = 0.02
MAX_PROGRAMS = 6

Config = tuple[int, ...]


def knapsack(prices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Highest price of lengths that fit into each capacity, and the length to take first.

    ``prices[l]`` is that of a length, negative where it is not to be used. Of equal ones
    the longest is taken; 0 leaves a token empty.
    """
    capacity = len(prices) - 1
    best, first = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    falling = prices[::-1]
    for room in range(1, capacity + 1):
        found = falling[capacity - room : capacity] + best[:room]
        rest = int(found.argmax())
        if found[rest] > best[room - 1]:
            best[room], first[room] = found[rest], room - rest
        else:
            best[room] = best[room - 1]
    return best, first


def _filling(first: np.ndarray, room: int) -> list[int]:
    lengths = []
    while room:
        length = int(first[room])
        if length:
            lengths.append(length)
        room -= max(length, 1)
    return lengths


def cover(counts: np.ndarray, rounds: int = ROUNDS) -> tuple[dict[Config, float], float]:
    """Configurations that cover ``counts[l]`` pieces of each length l, and a lower bound.

    Weights start in proportion to the lengths, the prices at which every full
    configuration costs the same. The bound is the best dual solution of any round: prices
    divided by the dearest configuration's.
    """
    lengths = np.flatnonzero(counts)
    wanted = counts[lengths].astype(float)
    covered = np.zeros(len(counts))
    taken: dict[Config, float] = {}
    bound = 0.0
    for _ in range(rounds):
        prices = np.full(len(counts), -1.0)
        prices[lengths] = lengths * np.exp(-FALL * covered[lengths] / wanted)
        best, first = knapsack(prices)
        bound = max(bound, float(wanted @ prices[lengths]) / best[-1])
        around = prices[lengths] + best[len(counts) - 1 - lengths]
        added = np.zeros(len(counts))
        chosen = []
        for length in lengths[around >= (1 - NEAR) * around.max()].tolist():
            config = [length, *_filling(first, len(counts) - 1 - length)]
            chosen.append((tuple(sorted(config, reverse=True)), float(counts[length])))
            np.add.at(added, config, float(counts[length]))
        step = STEP / (added[lengths] / wanted).max()
        for config, amount in chosen:
            taken[config] = taken.get(config, 0.0) + step * amount
        covered += step * added
    scale = (covered[lengths] / wanted).min()
    return {config: amount / scale for config, amount in taken.items()}, bound


def _best_fit(counts: np.ndarray) -> Counter[Config]:
    """Each length, from the longest, into the open sequences with the least room for it."""
    rooms: list[Counter[Config]] = [Counter() for _ in counts]
    for length in range(len(counts) - 1, 0, -1):
        left, room = int(counts[length]), length
        while left:
            while room < len(rooms) and not rooms[room]:
                room += 1
            if room == len(rooms):  # none is open that has room: full new ones, and a rest
                each = (len(rooms) - 1) // length
                config = (length,) * min(each, left)
                opened = left // len(config)
                rooms[len(rooms) - 1 - length * len(config)][config] += opened
                left -= opened * len(config)
                room = length
                continue
            config, open_ = next(iter(rooms[room].items()))
            used = min(open_, left)
            rooms[room][config] -= used
            if used == open_:
                del rooms[room][config]
            rooms[room - length][config + (length,)] += used
            left -= used
    return sum(rooms, Counter())


@dataclass
class Plan:
    """How often each configuration is used, and the fewest sequences that any plan needs."""

    configs: dict[Config, int]
    lower_bound: int

    @property
    def sequences(self) -> int:
        return sum(self.configs.values())


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Configurations that hold exactly ``histogram[length]`` pieces of each length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        left[length] = count
    configs: Counter[Config] = Counter()
    if left[capacity]:
        configs[(capacity,)] = int(left[capacity])
    whole, left[capacity] = int(left[capacity]), 0
    bound = float(left[capacity // 2 + 1 :].sum())  # no two of them fit together
    for number in range(MAX_PROGRAMS):
        if not left.any():
            break
        solution, lower = cover(left)
        bound = max(bound, lower) if number == 0 else bound
        before, got, owed = int(left @ np.arange(capacity + 1)), 0, 0.0
        # Fractions add up along the configurations that resemble each other.
        for config in sorted(solution, reverse=True):
            owed += solution[config]
            uses, owed = int(owed), owed % 1.0
            if not uses:
                continue
            lengths, each = np.unique(config, return_counts=True)
            uses = min(uses, int((left[lengths] // each).min()))  # never beyond what is left
            if uses:
                left[lengths] -= uses * each
                configs[config] += uses
                got += uses * sum(config)
        if got < LEAST_TAKEN * before:
            break
    configs += _best_fit(left)
    return Plan(dict(configs), whole + int(np.ceil(bound - 1e-6)))


class _Places:
    """Sequence and offset of the piece with a number among the pieces of its length."""

    def __init__(self, plan: Plan, capacity: int):
        slots: dict[int, list[tuple[int, int, int, int]]] = {}
        first: Counter[int] = Counter()
        sequence = 0
        for config, uses in plan.configs.items():
            offset = 0
            for length, each in Counter(config).items():
                slots.setdefault(length, []).append((first[length], each, sequence, offset))
                first[length] += uses * each
                offset += length * each
            sequence += uses
        self.begin = np.zeros(capacity + 2, np.int64)
        for length, own in slots.items():
            self.begin[length + 1] = len(own)
        self.begin = np.cumsum(self.begin)
        rows = [row for length in sorted(slots) for row in slots[length]]
        self.rows = np.array(rows, np.int64).reshape(-1, 4)

    def of(self, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequences, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        order = np.argsort(lengths, kind="stable")
        groups = np.flatnonzero(np.diff(lengths[order], prepend=-1))
        for mine in np.split(order, groups[1:]) if len(order) else ():
            length = int(lengths[mine[0]])
            own = self.rows[self.begin[length] : self.begin[length + 1]]
            row = own[np.searchsorted(own[:, 0], numbers[mine], "right") - 1]
            use, slot = np.divmod(numbers[mine] - row[:, 0], row[:, 1])
            sequences[mine], offsets[mine] = row[:, 2] + use, row[:, 3] + slot * length
        return sequences, offsets


def pieces(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end: int = END,
    with_ids: bool = False,
) -> DataFrame:
    """``id, piece, start, length, crc, task, number`` (and ``ids``) of every piece.

    A document is its ids and the id ``end``; one of more than ``capacity`` ids is cut into
    pieces of that many, of which the first may be shorter. ``number`` counts the pieces of
    one length in one task. ``ids`` are unsigned 32-bit numbers, little-endian.
    """
    id_field = StructField("id", docs.schema[id_col].dataType)
    numbers = ("piece", "start", "length", "crc", "task", "number")
    fields = [StructField(name, LongType()) for name in numbers]
    schema = StructType([id_field, *fields] + [StructField("ids", BinaryType())] * with_ids)
    last = np.array([end], np.uint32).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = Encoder(vocabulary), Counter()
        task = TaskContext.get().partitionId()
        for batch in batches:
            owners, rows, held = [], [], []
            for owner, ids in enumerate(encoder.ids(batch["text"])):
                data = memoryview(ids.tobytes() + last)
                stop, piece, total = (len(ids) % capacity) + 1, 0, len(ids) + 1
                start = 0
                while start < total:
                    part = data[4 * start : 4 * stop]
                    length = stop - start
                    rows.append((piece, start, length, zlib.crc32(part), task, seen[length]))
                    seen[length] += 1
                    owners.append(owner)
                    if with_ids:
                        held.append(bytes(part))
                    start, stop, piece = stop, stop + capacity, piece + 1
            columns = np.array(rows, np.int64).reshape(-1, len(numbers)).T
            arrays = [batch["id"].take(pa.array(owners, pa.int64())), *map(pa.array, columns)]
            names = ["id", *numbers]
            if with_ids:
                arrays, names = [*arrays, pa.array(held, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    texts = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    return texts.mapInArrow(cut, schema)


def packed(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end: int = END,
    with_ids: bool = False,
) -> DataFrame:
    """``id, piece, start, length, crc, sequence, offset`` (and ``ids``) of every piece.

    ``pieces`` are written once. Their lengths' histogram, at most ``capacity`` rows, gives
    the plan in the driver. A piece is numbered among those of its length by a sum over the
    tasks that wrote them and its number there, and the plan says where that number goes;
    no texts move, and no length, however common, meets in one task. A sequence holds
    consecutive offsets from 0 and empty room only at its end.

    A null text is empty; an empty one is the end alone. Rows repeated in full, or under one
    id or none, are documents of their own. An empty table gives an empty result. Other
    columns of ``docs`` are left out.
    """
    if capacity < 1:
        raise ValueError("a sequence must hold a token")
    rows = saved(pieces(docs, vocabulary, id_col, text_col, capacity, end, with_ids))
    by_task = saved(rows.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")))
    totals = by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()
    places = _Places(plan({r["length"]: r["n"] for r in totals}, capacity), capacity)
    shared = docs.sparkSession.sparkContext.broadcast(places)

    @F.arrow_udf("struct<sequence:long,offset:long>")
    def place(length: pa.Array, number: pa.Array) -> pa.Array:
        sequences, offsets = shared.value.of(length.to_numpy(), number.to_numpy())
        return pa.StructArray.from_arrays(
            [pa.array(sequences), pa.array(offsets)], ["sequence", "offset"]
        )

    earlier = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    begins = by_task.select(
        "length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin")
    )
    found = rows.join(begins, ["length", "task"]).withColumn(
        "at", place.asNondeterministic()("length", F.col("begin") + F.col("number"))
    )
    columns = ["id", "piece", "start", "length", "crc", "at.sequence", "at.offset"]
    return found.select(*columns, *(["ids"] if with_ids else []))


def sequences(rows: DataFrame) -> DataFrame:
    """``sequence, ids, lengths`` from ``packed(..., with_ids=True)``: the tokens of every
    sequence as one binary, and the lengths of its pieces. A sequence has at most
    ``capacity`` tokens, so what is gathered is bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return (
        rows.groupBy("sequence")
        .agg(parts.alias("parts"))
        .select(
            "sequence",
            F.aggregate("parts", F.lit(b""), lambda done, p: F.concat(done, p["ids"])).alias("ids"),
            F.col("parts.length").alias("lengths"),
        )
    )
