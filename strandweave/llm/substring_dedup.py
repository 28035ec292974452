"""Exact substring dedup by suffix order (operator 1).

A string is ``LENGTH`` consecutive UTF-8 bytes of one document. Every byte
covered by a string that also starts in a document with a smaller doc_id is
removed; strings are judged on the input. The texts' segments around shared
anchors are dealt to shards; in each, all suffixes are put in order by the
difference-cover algorithm (sampled triples sorted, names sorted recursively,
the remaining suffixes merged) and the prefixes of neighbours are compared; a run
of equal prefixes takes the smallest document that holds it.

A suffix array of whole texts would move two thirds of all positions several
times over; anchors first rule out positions whose string cannot occur twice,
without losing any (see ``repeats``).

Null text is empty. Rows without an id are compared with nothing. Rows with one
id are one document: none removes anything from another, and each row is judged
by itself, be its text the same or not. Of equal strings the smallest id keeps its
own; nothing else can tie. An empty table gives an empty result. Only doc_id and
text are read, so other columns may have any name. A row's text is bounded by
memory alone. Windows around an anchor of very many documents are dealt one by
one, and an anchor whose distinct segments exceed ``CHUNK`` is cut by longer anchors
(``repeats.narrow``), so the order of a task has no other bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats, suffixes

LENGTH = 50
ROWS = 500  # texts turned into Python objects at a time
CHUNK = 1 << 20  # bytes of distinct segments that are ordered together


def _decide(contents: list[bytes], least: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of every distinct segment, one after the other: the smallest document that
    has each, and how many each segment has."""
    sizes = np.array([len(c) for c in contents])
    text = np.frombuffer(b"".join(contents), np.uint8)
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(len(contents)), sizes)
    starts = np.arange(len(text)) + n <= ends[of]
    group = suffixes.repeats(text, starts, n)
    low = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
    at = np.flatnonzero(starts)
    np.minimum.at(low, group[at], least[of[at]])
    return low[group[at]], sizes - n + 1


def _spans(own: list[list[tuple[int, int, int]]], low: np.ndarray, per: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """(doc, variant, low, high) of the covered runs of all places of all segments."""
    seg = np.repeat(np.arange(len(own)), [len(x) for x in own])
    doc, variant, base = np.array([x for row in own for x in row], np.int64).T
    count = per[seg]
    place = np.repeat(np.arange(len(seg)), count)
    step = np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count)
    hit = np.flatnonzero(low[(np.cumsum(per) - per)[seg][place] + step] < doc[place])
    place, start = place[hit], (base[place] + step)[hit]
    new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (np.diff(start) > n)))[: len(hit)])
    last = np.append(new[1:], len(hit))[: len(new)] - 1
    return doc[place[new]], variant[place[new]], start[new], start[last] + n


def anchor(n: int) -> int:
    """Bytes of an anchor: the largest power of two in two thirds of a string.

    A shorter one recurs by chance in ever more documents of a growing table, and
    all segments around it would have to be ordered; a longer one sends more messages.
    """
    return 1 << max(1, 2 * n // 3).bit_length() - 1


def locate(part: pa.Table, n: int = LENGTH, chunk: int = CHUNK, k: int = 16) -> pa.Table:
    """Covered byte ranges of one shard's segments, which were cut by anchors of ``k`` bytes."""
    names = ("doc_id", "variant", "low", "high")
    out, done = [], []
    places: dict[bytes, list[tuple[int, int, int]]] = {}
    by_anchor: dict[tuple[int, int], list[tuple[bytes, int]]] = {}
    for d, v, a, b, key, width, at, content in repeats.rows_of(part.column("data").to_pylist(), n, k):
        if content is None:
            done.append((d, v, a, b))
            continue
        own = places.get(content)
        if own is None:
            places[content] = [(d, v, a)]
            by_anchor.setdefault((key, width), []).append((content, at))
        else:
            own.append((d, v, a))
    out.append(tuple(np.array(done, np.int64).reshape(-1, 4).T))

    whole: list[tuple[int, int, int, int]] = []
    held, size = [], 0

    def settle() -> None:
        own = [x for _, x in held]
        low, per = _decide([c for c, _ in held], np.array([min(x)[0] for x in own]), n)
        out.append(_spans(own, low, per, n))

    def groups():
        for (_, width), contents in by_anchor.items():  # segments of different anchors share no window
            if len(contents) > 1 and sum(len(c) for c, _ in contents) > chunk:
                yield from repeats.narrow([(c, at, places[c]) for c, at in contents], n, width, chunk)
            else:
                yield [(c, places[c]) for c, _ in contents]

    for group in groups():
        if len(group) == 1:  # every string in it has the same documents
            content, own = group[0]
            if len(own) > 1:
                least = min(own)[0]
                whole.extend((d, v, a, a + len(content)) for d, v, a in own if d > least)
            continue
        more = sum(len(c) for c, _ in group)
        if held and size + more > chunk:
            settle()
            held, size = [], 0
        held += group
        size += more
    if held:
        settle()
    out.append(tuple(np.array(whole, np.int64).reshape(-1, 4).T))
    return pa.table({c: pa.array(np.concatenate(x)) for c, x in zip(names, zip(*out, strict=True), strict=True)})


def covered_bytes(docs: DataFrame, n: int = LENGTH) -> DataFrame:
    """doc_id, text, copy and ranges of covered bytes, for rows with an id."""
    rows = repeats.firsts(docs)
    k, chunk = anchor(n), CHUNK
    found = repeats.candidates(rows, repeats.byte_units, n, k)
    parts = repeats.segments(rows, found, repeats.byte_units, n, k)
    cover = parts.groupBy("bucket").applyInArrow(lambda part: locate(part, n, chunk, k), repeats.ROW)
    return repeats.with_cover(rows, cover)


def remove(docs: DataFrame, n: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary) for every row."""

    def run(batches):
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            total, gone, spans, kept = [], [], [], []
            for text, copy, ranges in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                data = (text or "").encode()
                mask = repeats.covered(ranges, len(data), n, copy)
                total.append(len(data))
                gone.append(0 if mask is None else int(mask.sum()))
                spans.append(0 if mask is None else int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()))
                kept.append(data if mask is None else np.frombuffer(data, np.uint8)[~mask].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (total, gone, spans)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    lost = docs.filter(F.col("doc_id").isNull()).select(F.col("doc_id").cast("long"), "text", F.lit(False).alias("copy"), F.lit(None).cast("array<struct<low: long, high: long>>").alias("ranges"))
    rows = covered_bytes(docs, n).select("doc_id", "text", "copy", "ranges").union(lost)
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(docs: DataFrame) -> DataFrame:
    return remove(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
