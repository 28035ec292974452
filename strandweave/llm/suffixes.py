"""Suffix order by a difference cover modulo three, in numpy.

``order(s, depth)`` sorts all suffixes of ``s`` by at least their first ``depth``
symbols. Suffixes at positions 1 and 2 modulo 3 are sampled: their triples are
sorted and named, the names are sorted recursively, and the remaining third is
sorted by first symbol and the following sample's rank and merged in. A level's
names stand for three times as many symbols as the one before; once a triple
covers ``depth`` symbols, or all names differ, recursion ends. Suffixes that
agree on ``depth`` symbols come out next to each other in any order.
"""

from __future__ import annotations

import numpy as np

LIMIT = (1 << 21) - 3  # symbols and ranks are packed into 64 bits


def order(s: np.ndarray, depth: int) -> np.ndarray:
    if len(s) > LIMIT:
        raise ValueError("too long for one task; use more shards")
    return _order(s.astype(np.int64) + 1, 1, depth)


def _order(s: np.ndarray, span: int, depth: int) -> np.ndarray:
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate((s, np.zeros(3, np.int64))).astype(np.uint64)
    ends = n + (n % 3 == 1)  # a sample at the end closes the first half
    p = np.concatenate((np.arange(1, ends, 3), np.arange(2, ends, 3)))
    t = np.append(t, np.zeros(3, np.uint64))
    key = (t[p] << np.uint64(42)) | (t[p + 1] << np.uint64(21)) | t[p + 2]
    by_key = np.argsort(key, kind="stable")
    new = np.concatenate(([True], np.diff(key[by_key]) != 0))
    if 3 * span < depth and not new.all():
        names = np.empty(len(p), np.int64)
        names[by_key] = np.cumsum(new)
        by_key = _order(names, 3 * span, depth)
    rank = np.zeros(n + 6, np.uint64)
    rank[p[by_key]] = np.arange(1, len(p) + 1, dtype=np.uint64)
    sample = p[by_key]
    sample = sample[sample < n]

    rest = np.arange(0, n, 3)
    one = (t[rest] << np.uint64(22)) | rank[rest + 1]
    by_one = np.argsort(one, kind="stable")
    rest, one = rest[by_one], one[by_one]
    two = (t[rest] << np.uint64(43)) | (t[rest + 1] << np.uint64(22)) | rank[rest + 2]
    a, b = sample[sample % 3 == 1], sample[sample % 3 == 2]
    before = np.searchsorted(np.sort((t[a] << np.uint64(22)) | rank[a + 1]), one)
    before += np.searchsorted(np.sort((t[b] << np.uint64(43)) | (t[b + 1] << np.uint64(22)) | rank[b + 2]), two)
    place = np.arange(len(rest)) + np.maximum.accumulate(before)
    out = np.empty(n, np.int64)
    free = np.ones(n, bool)
    free[place] = False
    out[place] = rest
    out[free] = sample
    return out


def repeats(text: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Class of each start in ``starts``: equal for equal ``n``-byte strings.

    ``starts`` is a mask of the positions at which ``n`` bytes may be read.
    Suffixes are put in order and neighbours' prefixes compared.
    """
    at = order(text, n)
    at = at[starts[at]]
    wide = np.concatenate((text, np.zeros(16, np.uint8)))
    word = np.zeros(len(text) + 8, np.uint64)
    for k in range(8):
        word |= wide[k : k + len(word)].astype(np.uint64) << np.uint64(8 * k)
    same = np.ones(max(0, len(at) - 1), bool)
    for off in [*range(0, n - 7, 8), n - 8] if n >= 8 else []:
        w = word[at + off]
        same &= w[1:] == w[:-1]
    if n < 8:
        w = word[at] & np.uint64((1 << 8 * n) - 1)
        same &= w[1:] == w[:-1]
    out = np.full(len(text), -1, np.int64)
    out[at] = np.cumsum(np.concatenate(([True], ~same))[: len(at)])
    return out
