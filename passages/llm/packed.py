"""Texts of a group as one array of bytes, and polynomial hashes of its substrings."""

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
OTHER_BASE = 0xD1342543DE82EF95
LONG_WORD = 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the word."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def values_of(base: int) -> np.ndarray:
    """A number for each value of a byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))


@dataclass
class Flat:
    """Text ``i`` is ``data[starts[i]:ends[i]]``; each is followed by one line end."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def flat(texts: list[bytes]) -> Flat:
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1) - 1
    data = np.frombuffer(b"\n".join([*texts, b""]) if texts else b"\n", np.uint8)
    return Flat(data, ends - lengths, ends)


class Hashes:
    """Hashes of substrings of ``values``, from hashes of its prefixes, modulo 2 ** 64."""

    def __init__(self, values: np.ndarray, base: int = BASE):
        n = len(values)
        steps = np.full(n + 1, base, np.uint64)
        steps[0] = 1
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(values * np.cumprod(steps)[:n], out=self.prefix[1:])
        steps = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
        steps[0] = 1
        self.shift = np.cumprod(steps)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.prefix[ends] - self.prefix[starts]) * self.shift[starts]

    def windows(self, length: int) -> np.ndarray:
        """Of every substring of one length, by where it starts."""
        n = len(self.prefix) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return (self.prefix[length:] - self.prefix[:n]) * self.shift[:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """A hash of each word.

    Polynomials modulo a power of two lose bits on long words of a regular build, whatever
    the base, so words of more than ``LONG_WORD`` bytes have a digest instead.
    """
    hashes = mix(Hashes(values_of(base)[data], base).of(starts, ends))
    key = base.to_bytes(8, "little")
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        digest = blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=key).digest()
        hashes[i] = int.from_bytes(digest, "little")
    return hashes


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than 0x20 and 0x09-0x0D."""
    space = np.ones(len(data) + 2, np.int8)
    space[1:-1] = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.flatnonzero(np.diff(space))
    return edges[0::2], edges[1::2]


def within(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in one of the intervals."""
    steps = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(steps[:n]) > 0


def first_of_runs(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for column in columns:
        new[1:] |= column[1:] != column[:-1]
    return new
