"""64-bit hashes of words, straight from Arrow string buffers.

Words are runs of bytes other than U+0009 .. U+000D and the blank, never across
texts. A word's hash depends on its bytes alone, on any machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.Philox(20260101))
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_power = [np.cumprod(np.full(1 << 12, _ODD, np.uint64))]


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    if len(_power[0]) < n:
        with np.errstate(over="ignore"):
            _power[0] = np.cumprod(np.full(1 << int(n - 1).bit_length(), _ODD, np.uint64))
    return _power[0]


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its row offsets; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``most`` bytes, a longer row alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last
        first = last


class Words:
    """Words of a run of texts: hash, byte span and the text they belong to."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        space = _SPACE[buf]
        before = np.concatenate(([True], space[:-1])) if len(buf) else space
        before[offsets[:-1][offsets[:-1] < len(buf)]] = True
        begins = ~space & before
        self.start = np.flatnonzero(begins)
        self.first = np.searchsorted(self.start, offsets)  # first word of each text, and the end
        letters = np.flatnonzero(~space)
        at = np.searchsorted(letters, self.start)
        size = np.diff(np.append(at, len(letters)))
        self.end = self.start + size
        if len(self.start):
            rel = np.arange(len(letters)) - np.repeat(at, size)
            with np.errstate(over="ignore"):
                h = np.add.reduceat(_BYTE[buf[letters]] * _powers(int(size.max()))[rel], at)
                self.hash = mix(h + size.astype(np.uint64) * _ODD)
        else:
            self.hash = np.empty(0, np.uint64)

    def text_of(self) -> np.ndarray:
        """Index of the text each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` values, by start."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * _ODD + h[k : len(h) - n + 1 + k]
    return mix(out)
