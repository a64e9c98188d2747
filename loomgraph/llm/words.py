"""Words of whole Arrow columns at once: a word is a run of bytes other than 0x20 and 0x09-0x0D, kept as byte ranges and 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Every ASCII byte but the letters, for words of letters.
NO_LETTER = np.array([c < 128 and not chr(c).isalpha() for c in range(256)])
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_GRAM = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of text that are worked on at once; a longer text is one piece by itself.
PIECE = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers under which each bit of the input reaches each of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base and of its inverse, made as far as they are asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_powers = _Powers()


@dataclass
class Words:
    """Words of consecutive rows: row i has words first[i] to first[i + 1]; word j is data[start[j]:end[j]]."""

    data: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray | None
    total: np.ndarray | None = None

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges: that of a word if the range is one."""
        return _ranges(self.total, start, end)

    def row(self, i: int) -> slice:
        return slice(int(self.first[i]), int(self.first[i + 1]))

    def text(self, j: int) -> bytes:
        return self.data[self.start[j] : self.end[j]].tobytes()


def pieces(column: pa.Array, hashed: bool = True, lower: bool = False, between: np.ndarray = _SPACE, size: int = PIECE) -> Iterator[tuple[int, int, Words]]:
    """(from, to, words) for runs of rows of a string column, in order; null texts have no words. ``between``: which bytes part words; ``size``: bytes of a run."""
    filled = pc.fill_null(column, "").cast(pa.large_binary())
    if not len(filled):
        return
    _, offsets, data = filled.buffers()
    at = np.frombuffer(offsets, np.int64)[filled.offset : filled.offset + len(filled) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(filled):
        high = max(low + 1, int(np.searchsorted(at, at[low] + size, "right")) - 1)
        own = whole[at[low] : at[high]]
        yield low, high, _words(_LOWER[own] if lower else own, at[low : high + 1] - at[low], hashed, between)
        low = high


def _ranges(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    down = _powers.get(len(total))[1]
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _GRAM)


def _words(data: np.ndarray, at: np.ndarray, hashed: bool, between: np.ndarray) -> Words:
    inside = ~between[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    edges = at[:-1][at[:-1] < len(data)]
    before[edges] = False
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    after[at[1:][at[1:] > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, at)
    if not hashed:
        return Words(data, first, start, end, None)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers.get(len(data) + 1)[0][:-1], out=total[1:])
    return Words(data, first, start, end, _ranges(total, start, end), total)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words, by doubling: length 2m comes from two of length m. Ends before the last n - 1 words."""
    if n > len(hashes):
        return np.zeros(0, np.uint64)
    done, have, length, power = None, hashes, 1, int(_GRAM)  # have[i]: words i to i + length
    taken, bits = 0, n
    while True:
        if bits & 1:
            if done is None:
                done, taken = have[: len(hashes) - length + 1], length
            else:
                size = len(hashes) - taken - length + 1
                done, taken = done[:size] * np.uint64(power) + have[taken : taken + size], taken + length
        bits >>= 1
        if not bits:
            return mixed(done)
        size = len(hashes) - 2 * length + 1
        have, length, power = have[:size] * np.uint64(power) + have[length : length + size], 2 * length, power * power % (1 << 64)


def joined(words: Words, kept: np.ndarray | None = None) -> list[memoryview]:
    """The words of each row with one space between them; ``kept``: a flag for each word."""
    at = np.arange(len(words.start)) if kept is None else np.flatnonzero(kept)
    n = len(words.first) - 1
    row = np.repeat(np.arange(n), np.diff(words.first))[at]
    more = np.zeros(len(at), bool)
    more[:-1] = row[1:] == row[:-1]
    start, stop = words.start[at], words.end[at] + more
    steps = np.zeros(len(words.data) + 2, np.int8)
    steps[start] += 1
    steps[stop] -= 1
    data = words.data.copy()
    data[words.end[at][more]] = 0x20
    flat = memoryview(data[np.cumsum(steps, dtype=np.int8)[: len(data)] > 0].tobytes())
    edge = np.concatenate([[0], np.cumsum(np.bincount(row, stop - start, minlength=n))]).astype(np.int64)
    return [flat[edge[i] : edge[i + 1]] for i in range(n)]
