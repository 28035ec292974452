"""Substring dedup by repeated-phrase automata (operator 8).

A window is ``WINDOW`` consecutive words of one document. Every word covered by
a window whose word sequence also starts in a document with a smaller doc_id is
removed; windows are judged on the input. Recurring windows are confirmed word
by word in shards of anchors, compiled into one Aho-Corasick automaton a shard
(a word is one symbol of its alphabet), and the shard's part of all documents is
streamed through it to locate every occurrence. A shard that may have more than
``SYMBOLS`` distinct words takes an automaton for every group of anchors, and an
anchor above that is cut by longer anchors (``repeats.narrow``).

Words are runs of bytes other than U+0009 .. U+000D and the blank, unchanged.
Null text has no words. Rows without an id are compared with nothing. Rows with
one id are one document: none removes anything from another, and each row is
judged by itself, be its text the same or not. Of equal windows the smallest id
keeps its own; nothing else can tie. An empty table gives an empty result. Only
doc_id and text are read (``keep_rest`` keeps all columns as they are), so other
columns may have any name. Text is streamed, so its length is bounded by a row's
memory alone.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import repeats

WINDOW, ANCHOR = 13, 4
SYMBOLS = 1 << 20  # distinct words of one automaton; code points allow 1,112,063
ROWS = 500  # texts turned into Python objects at a time


class _Symbols(dict):
    """One code point for each distinct word."""

    def __missing__(self, word: bytes) -> str:
        k = len(self) + 1
        self[word] = c = chr(k if k < 0xD800 else k + 0x800)
        return c


def locate(part: pa.Table, n: int = WINDOW) -> pa.Table:
    """Covered word ranges of one shard's segments."""
    out: list[list[int]] = [[], [], [], []]
    by_anchor: dict[tuple[int, int], list[tuple[int, int, int, int, bytes]]] = {}

    def put(*row) -> None:
        for column, value in zip(out, row, strict=True):
            column.append(value)

    for d, v, a, b, key, width, at, content in repeats.rows_of(part.column("data").to_pylist(), n, ANCHOR):
        if content is None:
            put(d, v, a, b)
        else:
            by_anchor.setdefault((key, width), []).append((d, v, a, at, content))
    symbol, first, again, streams = _Symbols(), {}, {}, []

    def settle() -> None:
        if again:
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for w, least in again.items():
                automaton.add_word(w, least)
            automaton.make_automaton()
            for d, v, a, s in streams:
                begin = end = -1
                for at, least in automaton.iter(s):
                    if least < d:
                        if at - n + 1 > end:
                            if end >= 0:
                                put(d, v, a + begin, a + end)
                            begin = at - n + 1
                        end = at + 1
                if end >= 0:
                    put(d, v, a + begin, a + end)
        for x in (symbol, first, again, streams):
            x.clear()

    def groups():
        """Rows of words that share no window with other groups, and how many words they have."""
        while by_anchor:
            (_, width), rows = by_anchor.popitem()
            size = sum(content.count(b" ") + 1 for *_, content in rows)
            if size <= SYMBOLS:
                yield size, ((d, v, a, content.split(b" ")) for d, v, a, _, content in rows)
                continue
            places: dict[bytes, tuple[int, list[tuple[int, int, int]]]] = {}
            for d, v, a, at, content in rows:
                places.setdefault(content, (at, []))[1].append((d, v, a))
            group = [(tuple(c.split(b" ")), at, own) for c, (at, own) in places.items()]
            for some in repeats.narrow(group, n, width, SYMBOLS):
                yield sum(len(c) for c, _ in some), ((d, v, a, c) for c, own in some for d, v, a in own)

    for size, rows in groups():
        if streams and len(symbol) + size > SYMBOLS:
            settle()
        for d, v, a, words in rows:
            s = "".join(map(symbol.__getitem__, words))
            streams.append((d, v, a, s))
            for i in range(len(s) - n + 1):
                w = s[i : i + n]
                seen = first.setdefault(w, d)
                if seen != d:
                    again[w] = min(again.get(w, seen), d)
    settle()
    return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("doc_id", "variant", "low", "high"), out, strict=True)})


def covered_words(docs: DataFrame, n: int = WINDOW, whole: bool = False) -> DataFrame:
    """doc_id, text, copy and ranges of covered words, for rows with an id; ``whole`` adds the other columns."""
    rows = repeats.firsts(docs, whole)
    found = repeats.candidates(rows, repeats.word_units, n, ANCHOR)
    parts = repeats.segments(rows, found, repeats.word_units, n, ANCHOR)
    cover = parts.groupBy("bucket").applyInArrow(lambda part: locate(part, n), repeats.ROW)
    return repeats.with_cover(rows, cover)


def _rest(batch: pa.RecordBatch, n: int, untouched: bool) -> list[pa.Array]:
    """Words, removed words and what stays of (text, copy, ranges) rows."""
    words_n, gone_n, kept = [], [], []
    for text, copy, ranges in zip(*(batch.column(k).to_pylist() for k in ("text", "copy", "ranges")), strict=True):
        words = (text or "").encode().split()
        mask = repeats.covered(ranges, len(words), n, copy)
        words_n.append(len(words))
        gone_n.append(0 if mask is None else int(mask.sum()))
        if mask is None and untouched:
            kept.append(text or "")
            continue
        kept.append(b" ".join(words if mask is None else [w for w, m in zip(words, mask.tolist(), strict=True) if not m]).decode())
    return [pa.array(words_n, pa.int64()), pa.array(gone_n, pa.int64()), pa.array(kept, pa.string())]


def remove(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text, the kept words joined by one blank, for every row."""

    def run(batches):
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_rest(batch, n, False)], ["doc_id", "n_words", "n_removed", "kept_text"])

    lost = docs.filter(F.col("doc_id").isNull()).select(F.col("doc_id").cast("long"), "text", F.lit(False).alias("copy"), F.lit(None).cast("array<struct<low: long, high: long>>").alias("ranges"))
    rows = covered_words(docs, n).select("doc_id", "text", "copy", "ranges").union(lost)
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


def keep_rest(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """Rows of ``docs`` with the text that stays; rows left without words go.

    A text that loses nothing stays as it is. ``n_chars`` follows the text; other
    columns stay. Repeated rows are all kept, rows without an id pass unchanged.
    """
    rows = covered_words(docs, n, whole=True).select("text", "copy", "ranges", "rest")

    def run(batches):
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            yield pa.RecordBatch.from_arrays([batch.column("rest"), *_rest(batch, n, True)], ["rest", "n_words", "n_removed", "kept_text"])

    schema = T.StructType([rows.schema["rest"], *[T.StructField(c, T.LongType()) for c in ("n_words", "n_removed")], T.StructField("kept_text", T.StringType())])
    kept = rows.mapInArrow(run, schema).filter("n_words > n_removed")
    new = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return kept.select(*[new.get(c, F.col("rest").getField(c)).alias(c) for c in docs.columns]).union(docs.filter(F.col("doc_id").isNull()))


def digests(docs: DataFrame) -> DataFrame:
    return remove(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
