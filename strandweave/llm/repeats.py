"""Repeated windows across documents: the part that operators 1 and 8 share.

A window is ``n`` consecutive units (bytes or words) of one document. Its anchor
is the leftmost smallest hash among the ``k``-unit runs inside it, so equal
windows have equal anchors at equal places. Consecutive windows with one anchor
form a segment, and segments split a document's windows without overlap.

1. ``candidates``: every partition sends each distinct anchor hash once, with its
   smallest document; anchors seen in two documents come back to those documents.
   No equal window is lost, and an anchor that a third of all documents hold
   costs one message for each partition.
2. ``segments``: candidate segments leave their documents. Equal segments of a
   partition leave once, for the smallest document; later documents are covered
   there and then. A segment around an anchor of ``HOT`` documents or more (part of
   a line that many documents hold, say) leaves as its windows, each its own anchor:
   a partition sends a window once, so no bucket gets more of it than there are
   partitions.
3. The operators decide, within anchor buckets, which windows also start in a
   smaller document, by their own methods, and return covered unit ranges.
4. ``with_cover`` brings the ranges back to the documents.

Exact copies are one text to steps 1 to 3: only the smallest doc_id of equal
texts takes part, and later copies are covered whole. Rows are told apart by
(doc_id, variant): the variant is 0 unless an id comes with several texts. Such
rows are one document, none removes anything from another, and every row is
judged against the documents with smaller ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordhash
from .common import lookup, partitions

ANCHOR_BITS = 56  # of an anchor's hash; equal hashes of different anchors only cost time
FLUSH = 2_000_000  # anchors a worker holds before it sends them
HOT = 4096  # documents from which on the windows around an anchor are dealt one by one
HOT_SHARE = 2  # and at least this part of its bucket's pairs of anchor and document: at most so many hot anchors a bucket
SENT_BITS = 39  # of these, the ones that messages of ``candidates`` hold: with a flag five bytes
FLAG = np.uint64(1 << SENT_BITS)  # marks a hot anchor
WINDOW = 127  # place of an anchor that is a window; windows hold at most so many runs
ROW = "doc_id long, variant long, low long, high long"


class Units:
    """Hashes of the units of a run of texts, and where each text begins."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray, words: wordhash.Words | None = None):
        self.hash, self.first, self.words = hashes, first, words


def byte_units(buf: np.ndarray, offsets: np.ndarray) -> Units:
    return Units(wordhash._BYTE[buf], offsets)


def word_units(buf: np.ndarray, offsets: np.ndarray) -> Units:
    w = wordhash.Words(buf, offsets)
    return Units(w.hash, w.first, w)


def _slide(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def _runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` units; k is a power of two."""
    size, power = 1, np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        while size < k:
            h = h[:-size] * power + h[size:]
            power, size = np.multiply(power, power), 2 * size
        return wordhash.mix(h)


def cut_segments(u: Units, n: int, k: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, text, first window, last window, anchor) of every segment; windows and anchors by unit index."""
    none = (np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(4)))
    total = len(u.hash)
    if total < n:
        return none
    h = _runs(u.hash, k)
    bits = np.uint64(max(1, int(total).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    at = _slide((h & ~low) | np.arange(len(h), dtype=np.uint64), n - k + 1) & low
    per = np.diff(u.first)
    ok = np.repeat(u.first[1:], per)[: len(at)] - np.arange(len(at)) >= n
    start = np.flatnonzero(ok)
    if not len(start):
        return none
    anchor = at[start].astype(np.int64)
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)))
    lead = np.flatnonzero(new)
    last = start[np.append(lead[1:], len(start)) - 1]
    first = start[lead]
    name = wordhash.mix(h[anchor[lead]]) >> np.uint64(64 - ANCHOR_BITS)  # smallest hashes are small: spread them again
    return name, np.searchsorted(u.first, first, "right") - 1, first, last, anchor[lead]


def firsts(docs: DataFrame, whole: bool = False) -> DataFrame:
    """(doc_id, variant, text, copy): ``copy`` if a document with a smaller id has the same text.

    Rows without an id are left out. ``whole`` adds ``rest``, a struct of all other columns and the id.
    """
    rest = [F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("rest")] if whole else []
    own = F.col("doc_id") if docs.schema["doc_id"].dataType == T.LongType() else F.col("doc_id").cast("long").alias("doc_id")  # an alias would keep plans from sharing the shuffle
    rows = docs.filter(F.col("doc_id").isNotNull()).select(own, F.coalesce(F.col("text"), F.lit("")).alias("text"), *rest)
    tags = rows.select("doc_id", F.unhex(F.md5("text")).alias("tag"), F.xxhash64("text").alias("short"))
    low = tags.groupBy("tag").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    later = lookup(tags.select("doc_id", "tag"), low.filter("n > 1"), "tag", "n", "doc_id").filter("doc_id > low").select("doc_id", F.lit(1).alias("later"), F.lit(0).alias("several"))
    several = tags.groupBy("doc_id").agg((F.min("short") != F.max("short")).alias("x")).filter("x").select("doc_id", F.lit(0), F.lit(1))
    marks = later.union(several).groupBy("doc_id").agg(F.max("later").alias("later"), F.max("several").alias("several"))
    many = F.coalesce(F.col("several"), F.lit(0)) == 1
    return rows.join(marks, "doc_id", "left").select(
        "doc_id", F.when(many, F.xxhash64(F.md5("text"))).otherwise(0).alias("variant"), "text",
        (~many & (F.coalesce("later", F.lit(0)) == 1)).alias("copy"), *(["rest"] if whole else []),
    )


def _batches(column: pa.Array, units: Callable):
    buf, offsets = wordhash.strings(column)
    for a, b in wordhash.slices(offsets):
        mine = offsets[a : b + 1] - offsets[a]
        part = buf[offsets[a] : offsets[b]]
        yield a, part, mine, units(part, mine)


def _pack(*columns: np.ndarray) -> bytes:
    """64-bit columns, the first ascending and kept as differences: byte planes, compressed."""
    first = np.diff(columns[0].astype(np.uint64), prepend=np.uint64(0))
    raw = b"".join(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes() for x in (first.view(np.int64), *columns[1:]))
    return len(first).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def _unpack(data: bytes, width: int) -> tuple[np.ndarray, ...]:
    n = int.from_bytes(data[:8], "little")
    raw = pa.Codec("zstd").decompress(data[8:], decompressed_size=8 * n * width, asbytes=True)
    out = [np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 8 * n * k).reshape(8, n).T).view(np.int64).ravel() for k in range(width)]
    return np.cumsum(out[0].view(np.uint64), dtype=np.uint64), *out[1:]


def _sent(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(ANCHOR_BITS - SENT_BITS)


def _five(h: np.ndarray) -> bytes:
    """Numbers of up to 40 bits, five bytes each."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _numbers(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def candidates(docs: DataFrame, units: Callable, n: int, k: int) -> DataFrame:
    """(doc_id, anchors): for documents with anchors that another document has, five bytes each.

    All messages travel as compressed blocks, a bounded number for each task.
    """
    buckets, most, hot_from, hot_share = 2 * partitions(docs.sparkSession), FLUSH, HOT, HOT_SHARE  # as set here, not in a worker

    def by_document(d: np.ndarray, h: np.ndarray):
        """(target bucket, block) of (document, anchor) pairs."""
        to = d % buckets
        order = np.lexsort((h, to))
        d, h, to = d[order], h[order], to[order]
        edge = np.searchsorted(to, np.arange(buckets + 1))
        for b in range(buckets):
            x, y = edge[b], edge[b + 1]
            if x < y:
                yield b, _pack(h[x:y], d[x:y])

    def rows(kind: int, pairs) -> pa.RecordBatch:
        pairs = list(pairs)
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in pairs], pa.int32()), pa.array([kind] * len(pairs), pa.int32()), pa.array([x for _, x in pairs], pa.binary())], ["bucket", "kind", "data"])

    def local(hashes: list, ids: list):
        h, d = np.concatenate(hashes), np.concatenate(ids)
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1]))))
        h, d = h[new], d[new]
        lead = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        count = np.diff(np.append(lead, len(h)))
        near = np.repeat(count > 1, count)  # documents that share an anchor right here
        yield rows(1, by_document(d[near], h[near]))
        h, d = h[lead], d[lead]
        edge = np.searchsorted(h, np.array([(i << SENT_BITS) // buckets for i in range(buckets)] + [1 << SENT_BITS], dtype=np.uint64))
        yield rows(0, ((b, _pack(h[x:y], d[x:y], count[x:y])) for b, (x, y) in enumerate(zip(edge, edge[1:], strict=False)) if x < y))

    def send(batches):
        hashes, ids, held = [], [], 0
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            for a, _, _, u in _batches(batch.column(1), units):
                h, text, *_ = cut_segments(u, n, k)
                hashes.append(_sent(h))
                ids.append(doc[a + text])
                held += len(h)
                if held >= most:
                    yield from local(hashes, ids)
                    hashes, ids, held = [], [], 0
        if held:
            yield from local(hashes, ids)

    def reply(part: pa.Table) -> pa.Table:
        """Blocks of (anchor, document) pairs by the document's bucket, and hot anchors to all buckets."""
        out, met = [], []
        for kind, x, b in zip(part.column("kind").to_pylist(), part.column("data").to_pylist(), part.column("bucket").to_pylist(), strict=True):
            if kind:
                out.append((b, False, x))
            else:
                met.append(_unpack(x, 3))
        if met:
            h, d, count = (np.concatenate(c) for c in zip(*met, strict=True))
            order = np.argsort(h, kind="stable")
            h, d, count = h[order], d[order], count[order]
            lead = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            size = np.diff(np.append(lead, len(h)))
            shared = np.repeat(size > 1, size) & (count == 1)
            out.extend((b, False, x) for b, x in by_document(d[shared], h[shared]))
            total = np.add.reduceat(count, lead)
            hot = h[lead[total >= max(hot_from, total.sum() / hot_share)]]
            if len(hot):
                out.extend((b, True, hot.tobytes()) for b in range(buckets))
        to, kind, data = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"target": pa.array(to, pa.int32()), "hot": pa.array(kind, pa.bool_()), "data": pa.array(data, pa.binary())})

    def gather(part: pa.Table) -> pa.Table:
        hot = np.frombuffer(b"".join(part.filter(part.column("hot")).column("data").to_pylist()), np.uint64)
        blocks = [_unpack(x, 2) for x, other in zip(part.column("data").to_pylist(), part.column("hot").to_pylist(), strict=True) if not other]
        if not blocks:
            return pa.table({"doc_id": pa.array([], pa.int64()), "anchors": pa.array([], pa.binary())})
        h, d = (np.concatenate(c) for c in zip(*blocks, strict=True))
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))  # repeated rows tell the same
        h, d = h[new], d[new]
        h = np.where(np.isin(h, hot), h | FLAG, h)
        cuts = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        return pa.table({"doc_id": pa.array(d[cuts]), "anchors": pa.array([_five(h[a:b]) for a, b in zip(cuts, np.append(cuts[1:], len(d)), strict=True)], pa.binary())})

    texts = docs.filter(~F.col("copy")).select("doc_id", "text")
    met = texts.mapInArrow(send, "bucket int, kind int, data binary").groupBy("bucket").applyInArrow(reply, "target int, hot boolean, data binary")
    return met.groupBy("target").applyInArrow(gather, "doc_id long, anchors binary")


def halves(content, p: int, n: int, k: int):
    """The two parts of a segment by the longer run that their windows hold: (part, its offset, place and length of the run).

    All windows of ``content`` hold the ``k`` units at ``p`` and so ``n - k`` units
    around them: half of those on the left, or more than the other half on the right.
    """
    left = (n - k + 1) // 2
    right = n - k - left + 1
    cut = max(0, min(len(content) - n, p - left) + 1)  # windows with ``left`` units before the run
    if cut:
        yield content[: cut - 1 + n], 0, p - left, k + left
    if cut <= len(content) - n:
        yield content[cut:], cut, p - cut, k + right


def _name(window: bytes) -> int:
    """Anchor number of a window."""
    return int.from_bytes(hashlib.blake2b(window, digest_size=ANCHOR_BITS // 8).digest(), "little")


def segments(docs: DataFrame, found: DataFrame, units: Callable, n: int, k: int) -> DataFrame:
    """(bucket, data): blocks of candidate segments and covered ranges, see ``rows_of``."""
    buckets = 2 * partitions(docs.sparkSession)  # a task sends each bucket one block at a time

    def flush(held: dict):
        out: dict[int, list[list]] = {}
        gone: dict[tuple[int, int], list[tuple[int, int]]] = {}

        def put(bucket: int, *row) -> None:
            for column, value in zip(out.setdefault(bucket, [[] for _ in row]), row, strict=True):
                column.append(value)

        for (anchor, content), places in held.items():
            least = min(places)[0]
            for doc, variant, low, high in places:
                if doc == least:
                    put((anchor & (1 << ANCHOR_BITS) - 1) % buckets, anchor, doc, variant, low << 32 | high, content)
                else:
                    gone.setdefault((doc, variant), []).append((low, high))
        for (doc, variant), ranges in gone.items():
            ranges.sort()
            low, high = ranges[0]
            for a, b in ranges[1:]:
                if a > high:
                    put(doc % buckets, 0, doc, variant, low << 32 | high, b"")
                    low = a
                high = max(high, b)
            put(doc % buckets, 0, doc, variant, low << 32 | high, b"")
        names = list(out)
        for a in range(0, len(names), 256):
            some = names[a : a + 256]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([block_of(*out.pop(x)) for x in some], pa.binary())], ["bucket", "data"])

    def send(batches):
        held: dict = {}
        size = 0
        for batch in batches:
            doc, variant = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            want = [_numbers(x) for x in batch.column(3).to_pylist()]
            for a, buf, _, u in _batches(batch.column(2), units):
                h, text, first, last, anchor = cut_segments(u, n, k)
                data, edge, short = buf.tobytes(), np.searchsorted(text, np.arange(len(u.first))), _sent(h)
                for t in range(len(u.first) - 1):
                    x, y = edge[t], edge[t + 1]
                    if x == y or not len(want[a + t]):
                        continue
                    mine = np.sort(want[a + t] & ~FLAG)
                    hot = set((want[a + t][want[a + t] >= FLAG] & ~FLAG).tolist())
                    at = np.minimum(np.searchsorted(mine, short[x:y]), len(mine) - 1)
                    pick = x + np.flatnonzero(mine[at] == short[x:y])
                    base, who, which = int(u.first[t]), int(doc[a + t]), int(variant[a + t])
                    to, places = h[pick].tolist(), (anchor[pick] - first[pick]).tolist()
                    for b, f, e, p in zip(to, first[pick].tolist(), (last[pick] + n).tolist(), places, strict=True):
                        content = data[f:e] if u.words is None else b" ".join(data[u.words.start[f] : u.words.end[e - 1]].split())
                        low = f - base
                        if b >> ANCHOR_BITS - SENT_BITS not in hot:
                            held.setdefault((b | p << ANCHOR_BITS, content), []).append((who, which, low, e - base))
                            size += len(content) + 120
                            continue
                        split = content if u.words is None else content.split(b" ")
                        for i in range(e - f - n + 1):
                            window = split[i : i + n] if u.words is None else b" ".join(split[i : i + n])
                            held.setdefault((_name(window) | WINDOW << ANCHOR_BITS, window), []).append((who, which, low + i, low + i + n))
                            size += len(window) + 120
                if size > 160 << 20:
                    yield from flush(held)
                    held, size = {}, 0
        yield from flush(held)

    rows = docs.filter(~F.col("copy")).select("doc_id", "variant", "text").join(found, "doc_id")
    return rows.select("doc_id", "variant", "text", "anchors").mapInArrow(send, "bucket int, data binary")


def block_of(anchor: list[int], doc: list[int], variant: list[int], span: list[int], content: list[bytes]) -> bytes:
    """Rows as one block: numbers by byte plane, then all contents, compressed.

    ``anchor`` holds its number and, above ``ANCHOR_BITS``, its place in the content, or
    ``WINDOW`` if it is the content itself; ``span`` has the first unit in the document in
    its upper half and the end in its lower one; a content is a segment's bytes, or
    its words joined by one blank, and empty for a covered range.
    """
    order = np.argsort(np.array(anchor, np.int64), kind="stable").tolist()
    numbers = [np.array(c, np.int64)[order] for c in (anchor, doc, variant, span, [len(c) for c in content])]
    numbers[0] = np.diff(numbers[0], prepend=0)
    raw = b"".join([*(x.view(np.uint8).reshape(-1, 8).T.tobytes() for x in numbers), *(content[k] for k in order)])
    return len(order).to_bytes(4, "little") + len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def rows_of(blocks: list[bytes], n: int, k: int):
    """(doc_id, variant, low, high, anchor number, its width and place, content or None) of every row of blocks."""
    for data in blocks:
        size = int.from_bytes(data[:4], "little")
        raw = pa.Codec("zstd").decompress(data[12:], decompressed_size=int.from_bytes(data[4:12], "little"), asbytes=True)
        anchor, doc, variant, span, length = (np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * size, 8 * size * c).reshape(8, size).T).view(np.int64).ravel() for c in range(5))
        anchor = np.cumsum(anchor)
        place = anchor >> ANCHOR_BITS
        window = place == WINDOW
        end = 40 * size + np.cumsum(length)
        contents = [raw[a:b] or None for a, b in zip((end - length).tolist(), end.tolist(), strict=True)]
        yield from zip(
            doc.tolist(), variant.tolist(), (span >> 32).tolist(), (span & 0xFFFFFFFF).tolist(), (anchor & (1 << ANCHOR_BITS) - 1).tolist(),
            np.where(window, n, k).tolist(), np.where(window, 0, place).tolist(), contents, strict=True,
        )


def narrow(group: list, n: int, k: int, bound: int):
    """Lists of (content, places) of at most ``bound`` units, or of one content, without a common window.

    ``group`` has (content, place of the anchor, places); its contents have one
    anchor of ``k`` units. Every segment is cut in two (``halves``), and the parts get
    the longer run as anchor, until they fit or the anchor is the window.
    """
    if len(group) == 1 or sum(len(c) for c, _, _ in group) <= bound:
        yield [(c, own) for c, _, own in group]
        return
    finer: dict = {}
    for c, p, own in group:
        for part, off, place, more in halves(c, p, n, k):
            on_left = off + place < p
            same = finer.setdefault((more, on_left, part[place : place + more]), {})
            same.setdefault(part, (place, []))[1].extend((d, v, a + off) for d, v, a in own)
    group.clear()
    while finer:
        (more, *_), parts = finer.popitem()
        yield from narrow([(c, p, own) for c, (p, own) in parts.items()], n, more, bound)


def with_cover(docs: DataFrame, cover: DataFrame) -> DataFrame:
    """docs with ``ranges``: the covered unit ranges of each row, or null.

    The join's key is the id alone, as in all other joins, so that the text is
    shuffled once; variants are told apart by a condition on top of it.
    """
    ranges = cover.groupBy(F.col("doc_id").alias("_id"), F.col("variant").alias("_variant")).agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    same = (F.col("doc_id") == F.col("_id")) & (F.col("variant").bitwiseXOR(F.col("_variant")) == 0)
    return docs.join(ranges, same, "left").drop("_id", "_variant")


def covered(ranges: list | None, total: int, n: int, copy: bool) -> np.ndarray | None:
    """Mask of covered units; None if nothing is covered."""
    if copy and total >= n:
        return np.ones(total, bool)
    if not ranges:
        return None
    step = np.zeros(total + 1, np.int64)
    np.add.at(step, [r["low"] for r in ranges], 1)
    np.add.at(step, [r["high"] for r in ranges], -1)
    return np.cumsum(step[:-1]) > 0
