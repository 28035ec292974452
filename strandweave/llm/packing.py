"""Best-fit packing under conflicts (operator 10).

Every text is ``octet_length + 1`` units long (one for the separator) and is cut
into pieces of at most ``CAPACITY`` units. Pieces go into bins of that capacity,
longest first; a piece takes the fullest bin that still holds it and has no
piece of the same source or of the same duplicate cluster. Bins are ordered by
residual in a tree whose nodes carry the common bits of the source and cluster
bitmaps beneath them: a subtree in which all bins share a bit with the piece is
skipped, otherwise the successor search goes on until the tightest compatible
bin is found, so no cap on attempts is needed. A piece of full capacity fills a
bin of its own.

Rows are dealt by a hash of their id to independent shards of about
``SHARD_ROWS`` rows, so a hot source or group of copies is spread evenly and a
task's memory stays bounded. The tightest bin is the tightest of the piece's own
shard: an open bin of another shard is never looked at. The duplicate cluster is the text itself (its
sha-256) unless a column is named.

Null text counts as empty (one unit). A null source, and an empty text's
cluster, conflict with nothing. Rows without an id are dealt by their place, so
that they spread too. Repeated rows are packed one by one; pieces of one length
come by doc_id and piece, and of bins that are equally tight the one that has been
so longest is taken. Very long texts are cut like others. Only doc_id, text, source
and the named cluster column are read, so other columns may have any name. An
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 8192
SHARD_ROWS = 8192


class ResidualTree:
    """Bins by residual, with the AND of their bitmaps in every node."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.common = [-1] * (2 * self.size)  # -1: nothing beneath
        self.bins: dict[int, dict[int, list[int]]] = {}  # residual -> bitmap -> bins

    def _refresh(self, residual: int) -> None:
        at, common = residual + self.size, -1
        for bits in self.bins.get(residual, ()):
            common &= bits
        tree = self.common
        tree[at] = common
        at >>= 1
        while at:
            new = tree[2 * at] & tree[2 * at + 1]
            if tree[at] == new:
                break
            tree[at] = new
            at >>= 1

    def add(self, residual: int, bits: int, name: int) -> None:
        self.bins.setdefault(residual, {}).setdefault(bits, []).append(name)
        self._refresh(residual)

    def take(self, length: int, bits: int) -> tuple[int, int, int] | None:
        """Remove and return (residual, bitmap, bin) of the tightest compatible bin."""
        tree, size = self.common, self.size
        stack, at = [], length + size
        # Subtrees that cover [length, size), nearest residuals on top.
        while at > 1:
            if at == length + size:
                stack.append(at)
            if not at & 1:
                stack.append(at + 1)
            at >>= 1
        stack.reverse()
        while stack:
            at = stack.pop()
            if tree[at] & bits or tree[at] == -1:
                continue
            if at < size:
                stack.append(2 * at + 1)
                stack.append(2 * at)
                continue
            held = self.bins[at - size]
            for other in held:  # insertion order: the oldest pattern first
                if not other & bits:
                    names = held[other]
                    name = names.pop(0)
                    if not names:
                        del held[other]
                        if not held:
                            del self.bins[at - size]
                    self._refresh(at - size)
                    return at - size, other, name
        return None


def pack(lengths: np.ndarray, sources: list, clusters: list, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece; pieces come longest first."""
    tree = ResidualTree(capacity)
    codes: dict = {}
    often = {}
    for kind, column in enumerate((sources, clusters)):
        for x in column:
            if x is not None:
                often[kind, x] = often.get((kind, x), 0) + 1
    for key, n in often.items():
        if n > 1:  # a value that occurs once conflicts with nothing
            codes[key] = 1 << len(codes)
    bins, offsets, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for k, length in enumerate(map(int, lengths)):
        if length >= capacity:
            bins[k], used = used, used + 1
            continue
        bits = codes.get((0, sources[k]), 0) | codes.get((1, clusters[k]), 0)
        found = tree.take(length, bits)
        if found is None:
            found, used = (capacity, 0, used), used + 1
        residual, held, name = found
        bins[k], offsets[k] = name, capacity - residual
        if residual > length:
            tree.add(residual - length, held | bits, name)
    return bins, offsets


def best_fit(docs: DataFrame, capacity: int = CAPACITY, cluster: str | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, piece, n_units, bin_id and offset for every piece of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    group = F.col(cluster).cast("string") if cluster else F.when(text != "", F.sha2(text, 256))
    shards = max(1, -(-docs.count() // shard_rows))
    rows = docs.select(
        "doc_id",
        F.col("source").cast("string").alias("_source"),
        group.alias("_cluster"),
        F.pmod(F.xxhash64(F.col("doc_id"), group, F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())), F.lit(shards)).alias("_shard"),
        size.alias("_size"),
        F.posexplode(F.sequence(F.lit(0).cast("long"), size - 1, F.lit(capacity).cast("long"))).alias("piece", "_start"),
    ).select("doc_id", "_source", "_cluster", "_shard", "piece", F.least(F.lit(capacity).cast("long"), F.col("_size") - F.col("_start")).alias("n_units"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("n_units", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        shard = part.column("_shard")[0].as_py()
        bins, offsets = pack(part.column("n_units").to_numpy(), part.column("_source").to_pylist(), part.column("_cluster").to_pylist(), capacity)
        return pa.table(
            {
                "doc_id": part.column("doc_id"),
                "piece": part.column("piece"),
                "n_units": part.column("n_units"),
                "bin_id": pa.array((np.int64(shard) << 32) + bins),
                "bin_offset": pa.array(offsets),
            }
        )

    return rows.groupBy("_shard").applyInArrow(run, f"doc_id {kind}, piece int, n_units long, bin_id long, bin_offset long")
