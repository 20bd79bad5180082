"""Words and their hashes over whole Arrow text columns, as numpy arrays (no loop over rows or words).

A column is handled in slices of about ``SLICE`` bytes, so memory stays bounded; a longer single text is one slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

#: ASCII white space: blank and 0x09 to 0x0D.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII but letters and digits.
NOT_ALNUM = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
#: Bytes with A-Z lower-cased.
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


@dataclass
class Words:
    """Words of rows ``lo`` to ``hi`` of a column; ``first[i]`` to ``first[i + 1]`` are those of row ``lo + i``."""

    lo: int
    hi: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.first))


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, bytes, offsets) of a text column; null counts as empty."""
    column = pc.fill_null(pc.cast(column, pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(column: pa.Array, breaks: np.ndarray = SPACES, lower: bool = False) -> Iterator[Words]:
    """The maximal runs of bytes that aren't ``breaks``, never across rows."""
    for lo, hi, data, offsets in slices(column):
        inside = ~breaks[data]
        opens, closes = inside.copy(), inside.copy()
        if len(data):
            cuts = offsets[1:-1]
            cuts = cuts[(cuts > 0) & (cuts < len(data))]
            opens[1:] &= ~inside[:-1]
            opens[cuts] = inside[cuts]
            closes[:-1] &= ~inside[1:]
            closes[cuts - 1] = inside[cuts - 1]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        yield Words(lo, hi, LOWER[data] if lower else data, start, end, np.searchsorted(start, offsets))


@cache
def _byte_codes() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base ** i`` and its inverse modulo 2**64, for i below n at least."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE + 1)
        up, down = np.full(size, base & _MASK, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= 4 * SLICE:
            _POWERS[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _ranges(codes: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of codes[start:end] for each pair, equal for equal runs wherever they stand."""
    up, down = powers(base, len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    return _ranges(_byte_codes()[w.data], w.start, w.end, _BASE)


def run_hashes(codes: np.ndarray, start: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of ``length`` consecutive word hashes from each start. Seeds give independent hashes."""
    return _ranges(mix(codes + np.uint64((seed * _BASE + seed) & _MASK)), start, start + length, (0xD1342543DE82EF95 + 2 * seed * 0x2545F4914F6CDD1D) & _MASK | 1)
