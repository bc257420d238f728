import random
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
import pytest

from passages.llm import packing
from passages.llm.packing import knapsack, packed, plan, sequences
from passages.llm.tokens import Encoder

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def fewest(histogram, capacity):
    """By trying all configurations, for a few pieces."""

    @cache
    def need(left):
        if not any(left):
            return 0
        longest = max(i for i, n in enumerate(left) if n)
        best = sum(left)

        def extend(rest, room, most):
            nonlocal best
            options = [i for i in range(1, most + 1) if rest[i] and i <= room]
            if not options:
                best = min(best, 1 + need(rest))
            for i in options:
                extend(rest[:i] + (rest[i] - 1,) + rest[i + 1 :], room - i, i)

        extend(
            left[:longest] + (left[longest] - 1,) + left[longest + 1 :], capacity - longest, longest
        )
        return best

    return need(tuple(histogram.get(i, 0) for i in range(capacity + 1)))


def pieces_of(found):
    total = Counter()
    for config, uses in found.configs.items():
        for length in config:
            total[length] += uses
    return total


def test_knapsack_against_all_ways():
    draw = random.Random(2)
    for _ in range(30):
        prices = np.array([-1.0] + [draw.choice([-1.0, draw.random() * 9]) for _ in range(14)])
        best, first = knapsack(prices)
        for room in range(15):
            ways = [0.0] + [
                prices[i] + best[room - i] for i in range(1, room + 1) if prices[i] > 0
            ]
            assert best[room] == max(ways)
            assert abs(sum(prices[packing._filling(first, room)]) - best[room]) < 1e-9


def test_plans_of_few_pieces_against_all_plans():
    draw = random.Random(3)
    for _ in range(40):
        histogram = dict(Counter(draw.randint(1, 12) for _ in range(draw.randint(1, 11))))
        found = plan(histogram, 12)
        best = fewest(histogram, 12)
        assert pieces_of(found) == histogram
        assert all(sum(config) <= 12 for config in found.configs)
        assert found.lower_bound <= best <= found.sequences <= best + 1


@pytest.mark.parametrize("kind", ["even", "long", "short", "thirds", "one", "large"])
def test_plans_of_many_pieces_reach_the_bound(kind):
    draw = np.random.default_rng(4)
    n = 20_000
    lengths = {
        "even": draw.integers(1, 257, n),
        "long": draw.integers(120, 257, n),
        "short": draw.integers(1, 20, n),
        "thirds": np.repeat([86, 85, 84], n // 3),
        "one": np.array([200]),
        "large": draw.integers(1, 257, n),
    }[kind]
    times = 10**9 if kind == "large" else 1
    histogram = {k: v * times for k, v in Counter(lengths.tolist()).items()}
    found = plan(histogram, 256)
    assert pieces_of(found) == histogram
    assert all(sum(config) <= 256 for config in found.configs)
    best = found.lower_bound
    if kind == "long":  # two fit at most: the longest goes with the longest that fits
        best, rest = 0, sorted(lengths.tolist())
        while rest:
            best, last = best + 1, rest.pop()
            fitting = bisect_right(rest, 256 - last)
            if fitting:
                rest.pop(fitting - 1)
    assert found.lower_bound <= best
    assert best <= found.sequences <= 1.01 * best + 3
    assert len(found.configs) < 60_000


def test_words_give_the_ids_of_whole_texts(plain, odd_rows, random_rows):
    draw = random.Random(1)
    parts = ["a", "b'", "'s", " ", "  ", "\n", "\t", "\xa0", "\x1c", "\x85", "　", "é", "日"]
    parts += [".", "!)", "1", "²", "_", ",", "\x00", "<|endoftext|>", "́", "🎉", "\x0b", "x" * 60]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 14))) for _ in range(3000)]
    texts += [row[1] for row in odd_rows + random_rows]
    found = Encoder(PATH).ids(pa.array(texts))
    for text, ids in zip(texts, found, strict=True):
        assert ids.tolist() == plain(text), repr(text)
    assert list(Encoder(PATH).ids(pa.array([], pa.string()))) == []


def check(rows, found, plain, capacity):
    """Every document whole, cut where it must be, and every sequence without gaps."""
    wanted = Counter()
    for doc_id, text, *_ in rows:
        ids = [*plain(text), 2]
        first = (len(ids) - 1) % capacity + 1
        bounds = [0, *range(first, len(ids) + 1, capacity)]
        for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
            crc = zlib.crc32(np.array(ids[a:b], "<u4").tobytes())
            wanted[(doc_id, piece, a, b - a, crc)] += 1
    assert Counter(tuple(r[c] for c in ("id", "piece", "start", "length", "crc")) for r in found) == wanted
    by_sequence = defaultdict(list)
    for r in found:
        by_sequence[r["sequence"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return by_sequence


def test_documents_are_whole_and_sequences_gapless(docs_of, odd_rows, random_rows, plain):
    rows = odd_rows + random_rows + [(i, "the same text") for i in range(400)] + [(None, "the same text")] * 3
    frame = docs_of(rows)
    for capacity in (1024, 16):
        found = packed(frame, PATH, capacity=capacity, with_ids=True).collect()
        by_sequence = check(rows, found, plain, capacity)
        total = sum(r["length"] for r in found)
        assert len(by_sequence) <= 1.02 * -(-total // capacity) + 3
        for r in found:
            assert zlib.crc32(r["ids"]) == r["crc"] and len(r["ids"]) == 4 * r["length"]


def test_sequences_hold_the_tokens(docs_of, random_rows):
    rows = packed(docs_of(random_rows), PATH, capacity=64, with_ids=True)
    found = {r["sequence"]: r for r in sequences(rows).collect()}
    for r in rows.collect():
        whole = found[r["sequence"]]
        assert bytes(whole["ids"])[4 * r["offset"] :].startswith(bytes(r["ids"]))
        assert len(whole["ids"]) == 4 * sum(whole["lengths"])


def test_empty_table_and_bad_size(docs_of):
    assert packed(docs_of([]), PATH).collect() == []
    with pytest.raises(ValueError, match="hold a token"):
        packed(docs_of([]), PATH, capacity=0)
