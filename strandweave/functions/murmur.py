"""MurmurHash3 x64 128-bit, seed 0, both halves folded by exclusive or; vectorised."""

from __future__ import annotations

import numpy as np

# Fixed values of the public hash function.
C1, C2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)
F1, F2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _turn(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _finish(x: np.ndarray) -> np.ndarray:
    for f in (F1, F2):
        x = (x ^ (x >> np.uint64(33))) * f
    return x ^ (x >> np.uint64(33))


def murmur64(rows: np.ndarray) -> np.ndarray:
    """Folded hash of every row of an (n, length) byte matrix."""
    n, length = rows.shape
    wide = np.zeros((n, -(-length // 16) * 16 or 16), np.uint8)
    wide[:, :length] = rows
    words = wide.view("<u8").astype(np.uint64)
    lanes = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
    whole = length // 16
    with np.errstate(over="ignore"):
        for b in range(whole):
            for lane, (first, then, turn, back, plus) in enumerate(((C1, C2, 31, 27, 0x52DCE729), (C2, C1, 33, 31, 0x38495AB5))):
                lanes[lane] ^= _turn(words[:, 2 * b + lane] * first, turn) * then
                lanes[lane] = (_turn(lanes[lane], back) + lanes[1 - lane]) * np.uint64(5) + np.uint64(plus)
        if length % 16:
            lanes[1] ^= _turn(words[:, 2 * whole + 1] * C2, 33) * C1
            lanes[0] ^= _turn(words[:, 2 * whole] * C1, 31) * C2
        a, b = (x ^ np.uint64(length) for x in lanes)
        a = a + b
        b = b + a
        a, b = _finish(a), _finish(b)
        a = a + b
        b = b + a
    return a ^ b


def murmur64_of(value: bytes) -> int:
    return int(murmur64(np.frombuffer(value, np.uint8).reshape(1, -1))[0])
