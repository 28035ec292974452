"""Canonical (w, k)-minimizers, one vectorised pass over each sequence.

A window's minimizer is its smallest canonical k-mer, the right-most of equals.
A minimizer is kept if its key differs from the window's before it. Sequences
shorter than ``w + k - 1`` have none. Letters are compared in upper case.

Keys are either the k-mers themselves (``lex``: byte order) or their folded
murmur hashes (``murmur``: unsigned order). There is no shuffle and no row for a
base: a sequence goes in, its minimizers come out.

A k-mer over ACGT of up to 31 letters is a number of 62 bits until it is written:
``extract_sets`` and ``multiplicities`` group numbers (``packed``) and spell them
once a distinct key, in whole columns. Other k-mers travel as text (``key``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.murmur import murmur64

_UP = np.arange(256, dtype=np.uint8)
_UP[97:123] -= 32
_COMP = _UP.copy()
for _a, _b in zip(b"ACGT", b"TGCA", strict=True):
    _COMP[_a] = _b
_CODE = np.full(256, 255, np.uint8)
_CODE[list(b"ACGT")] = np.arange(4)
_BASES = np.frombuffer(b"ACGT", np.uint8)


def _packed(seq: np.ndarray, k: int) -> np.ndarray:
    """Canonical k-mers over ACGT, two bits a base: number order is byte order."""
    code = _CODE[seq].astype(np.uint64)
    fwd, rev = np.zeros(len(seq) - k + 1, np.uint64), np.zeros(len(seq) - k + 1, np.uint64)
    for i in range(k):
        c = code[i : i + len(fwd)]
        fwd = (fwd << np.uint64(2)) | c
        rev |= (np.uint64(3) - c) << np.uint64(2 * i)
    return np.minimum(fwd, rev)


def canonical_rows(seq: np.ndarray, k: int) -> np.ndarray:
    """Canonical k-mers as an (n, k) byte matrix."""
    fwd = np.lib.stride_tricks.sliding_window_view(seq, k)
    rev = _COMP[fwd[:, ::-1]]
    diff = fwd != rev
    at = diff.argmax(axis=1)
    rows = np.arange(len(fwd))
    smaller = rev[rows, at] < fwd[rows, at]
    return np.where(smaller[:, None], rev, fwd)


def order_keys(seq: np.ndarray, k: int, hash_order: str) -> tuple[np.ndarray, np.ndarray | None]:
    """Sort keys of all k-mers, and their bytes unless the keys hold them."""
    if hash_order == "lex" and k <= 31 and (_CODE[seq] < 4).all():
        return _packed(seq, k), None
    rows = canonical_rows(seq, k)
    if hash_order == "murmur":
        return murmur64(rows), rows
    flat = np.ascontiguousarray(rows).view(f"S{k}").ravel()
    return np.unique(flat, return_inverse=True)[1].astype(np.uint64), rows


def kmer_counts(seqs: DataFrame, id_col: str, seq_col: str, k: int) -> DataFrame:
    """(id, n_kmers, n_canonical) of every sequence with a k-mer."""
    kind = seqs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at, n, m = [], [], []
            for i, s in enumerate(batch.column(1).to_pylist()):
                seq = _UP[np.frombuffer((s or "").encode(), np.uint8)]
                if len(seq) >= k:
                    at.append(i)
                    n.append(len(seq) - k + 1)
                    m.append(len(np.unique(order_keys(seq, k, "lex")[0])))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(n, pa.int64()), pa.array(m, pa.int64())], [id_col, "n_kmers", "n_canonical"])

    return seqs.select(id_col, seq_col).mapInArrow(run, f"{id_col} {kind}, n_kmers long, n_canonical long")


def spell(keys: np.ndarray, k: int) -> pa.Array:
    """k-mers of packed keys as a string column."""
    out = np.empty((len(keys), k), np.uint8)
    for i in range(k):
        out[:, i] = _BASES[(keys >> np.uint64(2 * (k - 1 - i))) & np.uint64(3)]
    return pa.StringArray.from_buffers(len(keys), pa.py_buffer(np.arange(0, (len(keys) + 1) * k, k, dtype=np.int32).tobytes()), pa.py_buffer(out.tobytes()))


def _least(keys: np.ndarray, w: int) -> np.ndarray:
    """Smallest key of every window."""
    size = 1
    while 2 * size <= w:
        keys, size = np.minimum(keys[:-size], keys[size:]), 2 * size
    return np.minimum(keys[: len(keys) - (w - size)], keys[w - size :]) if size < w else keys


def minimizers(text: bytes, k: int, w: int, hash_order: str = "lex", places: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Position, key and, unless the key holds them, letters of every minimizer.

    Without ``places`` positions are those of the windows.
    """
    seq = _UP[np.frombuffer(text, np.uint8)]
    if len(seq) < w + k - 1:
        return np.empty(0, np.int64), np.empty(0, np.uint64), None
    keys, rows = order_keys(seq, k, hash_order)
    low = _least(keys, w)
    first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    if not places and rows is None:
        return first, low[first], None
    at = first + w - 1 - np.lib.stride_tricks.sliding_window_view(keys, w)[first, ::-1].argmin(axis=1)
    return at, keys[at], None if rows is None or hash_order == "murmur" else rows[at]


def listed(text: bytes, k: int, w: int, hash_order: str = "lex") -> list[tuple[int, str | int]]:
    """(position, key) of every minimizer: k-mer strings, or signed hash views."""
    at, keys, rows = minimizers(text, k, w, hash_order)
    own = keys.view(np.int64).tolist() if hash_order == "murmur" else spell(keys, k).to_pylist() if rows is None else _texts(rows)
    return list(zip(at.tolist(), own, strict=True))


def _texts(rows: np.ndarray) -> list[str]:
    return [r.tobytes().decode("latin-1") for r in rows]


def extract(seqs: DataFrame, id_col: str, seq_col: str, k: int, w: int, hash_order: str = "lex") -> DataFrame:
    """(id, pos, key): minimizers of every sequence, in order; null sequences have none."""
    kind = seqs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                of, pos, key = [], [], []
                for i, s in enumerate(part.column(1).to_pylist()):
                    at, keys, rows = minimizers((s or "").encode(), k, w, hash_order)
                    of.append(np.full(len(at), i, np.int32))
                    pos.append(at)
                    key.append(pa.array(keys.view(np.int64)) if hash_order == "murmur" else spell(keys, k) if rows is None else pa.array(_texts(rows), pa.string()))
                if of:
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.concatenate(of))), pa.array(np.concatenate(pos), pa.int64()), pa.concat_arrays(key)], [id_col, "pos", "key"])

    return seqs.select(id_col, seq_col).mapInArrow(run, f"{id_col} {kind}, pos long, key {'long' if hash_order == 'murmur' else 'string'}")


def extract_sets(reads: DataFrame, id_col: str, seq_col: str, k: int, w: int, hash_order: str = "lex") -> DataFrame:
    """(id, packed, key): the distinct keys of every row; a read is whole in its row, so nothing is shuffled.

    One of ``packed`` (a number) and ``key`` (text) is null; murmur keys are numbers.
    """
    kind = reads.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                of, packed, odd_of, odd = [np.empty(0, np.int32)], [np.empty(0, np.uint64)], [], []
                for i, s in enumerate(part.column(1).to_pylist()):
                    _, keys, rows = minimizers((s or "").encode(), k, w, hash_order, places=False)
                    if rows is None:
                        packed.append(np.unique(keys))
                        of.append(np.full(len(packed[-1]), i, np.int32))
                    else:
                        own = sorted(set(_texts(rows)))
                        odd += own
                        odd_of += [i] * len(own)
                n = sum(map(len, of))
                at = np.concatenate([*of, np.array(odd_of, np.int32)])
                numbers = pa.concat_arrays([pa.array(np.concatenate(packed).view(np.int64)), pa.nulls(len(odd), pa.int64())])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), numbers, pa.concat_arrays([pa.nulls(n, pa.string()), pa.array(odd, pa.string())])], [id_col, "packed", "key"])

    return reads.select(id_col, seq_col).mapInArrow(run, f"{id_col} {kind}, packed long, key string")


def spelled(rows: DataFrame, k: int, hash_order: str = "lex") -> DataFrame:
    """``rows`` with the key in place of ``packed`` and ``key``: text, or the hash itself."""
    rest = [c for c in rows.columns if c not in ("packed", "key")]
    if hash_order == "murmur":
        return rows.select(F.col("packed").alias("key"), *rest)

    def run(batches):
        for batch in batches:
            packed, key = batch.column(0), batch.column(1)
            known = packed.is_valid()
            text = spell(packed.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64), k)
            yield pa.RecordBatch.from_arrays([pc.if_else(known, text, key), *batch.columns[2:]], ["key", *rest])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select("packed", "key", *rest).mapInArrow(run, ", ".join(["key string", *(f"{c} {kinds[c]}" for c in rest)]))


def multiplicities(sets: DataFrame, k: int | None = None, hash_order: str = "lex") -> DataFrame:
    """(key, multiplicity) of key sets: the number of reads that hold the key.

    With ``k`` the keys are spelled, without it they stay (packed, key).
    """
    out = sets.groupBy("packed", "key").agg(F.count("*").alias("multiplicity"))
    return out if k is None else spelled(out, k, hash_order)


def histogram(spectrum: DataFrame) -> DataFrame:
    return spectrum.groupBy("multiplicity").agg(F.count("*").alias("freq"))


def shared_by(sets: DataFrame) -> DataFrame:
    """How many keys are held by exactly n sequences."""
    return multiplicities(sets).groupBy(F.col("multiplicity").alias("n")).agg(F.count("*").alias("keys"))
