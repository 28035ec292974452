"""Near-duplicate join on word n-grams (operator 2): MinHash LSH forest, then exact Jaccard.

Texts are sets of five-word shingles (all words as one shingle if there are
fewer than five; no words: no shingles and no links). Exact copies are one node.
A node has a signature of ``TREES`` times ``DEPTH`` MinHash values, and each tree
is the sorted list of its nodes' values: a prefix trie.

1. ``tries``: all trees are put in order by range partitions, so a crowded prefix
   is cut across tasks, and read in order. Neighbours that agree on all ``DEPTH``
   values are joined at once. Runs that agree on ``forest_depth`` values, the
   longest prefix that still reaches the target recall, are kept as buckets.
2. ``shortened``: matched prefixes are shortened only where that can still bring
   something: buckets whose members are joined already are left out. In the
   others two nodes are joined if they agree on a prefix long enough for both (a
   set of a few shingles has no similarity between 0.8 and the next it can reach, so
   it stops at a longer prefix) and if the number of equal values in their whole
   signatures is within ``Z`` deviations of what the threshold leads to expect.
3. ``verify``: joined nodes form groups; every pair inside a group is compared once
   by its shingles, word by word, in bounded blocks, so that a group of
   thousands of near copies neither meets in one task nor is emitted as pairs.

Steps 1 and 2 return a spanning set of joins, never pairs. A pair at the threshold
is missed with probability ``1 - RECALL`` at most, a more similar one with less.

Words are runs of bytes other than U+0009 .. U+000D and the blank. Null text
counts as empty. Rows without an id have no links and no class. Repeated rows count
as copies. Rows with one id and several texts are compared by their own
texts and belong to one class, since classes are made of ids. Only doc_id and text
are read, so other columns may have any name. Every row gets doc_id, n_links
(rows linked directly), component_id (smallest doc_id reachable) and kept. An
empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .blocks import deal, grouped, roots_of, settle
from .common import connected_components, cut, partitions

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 24, 8, 0.99999
Z = 6.0
BLOCK_ROWS, BLOCK_BYTES = 256, 4 << 20
SMALL = 32  # groups of at most so many rows share units of work
FEW = 16  # sets up to this size get their own prefix length


def forest_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix that reaches the recall; at least one value."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def least_similarity(n: int, threshold: float = THRESHOLD) -> float:
    """The smallest Jaccard similarity from the threshold on that a set of ``n`` can have."""
    unions = range(n, int(n / threshold + 1e-9) + 1)
    return min(math.ceil(threshold * u - 1e-9) / u for u in unions if math.ceil(threshold * u - 1e-9) <= n)


def agreement(threshold: float, values: int) -> int:
    """Equal signature values below which two sets are not at the threshold."""
    return max(0, math.floor(values * threshold - Z * math.sqrt(values * threshold * (1 - threshold))))


def shingles(column: pa.Array, n: int = SHINGLE):
    """Yield (first row, last row, shingle hashes, first shingle of each row and the end)."""
    buf, offsets = wordhash.strings(column)
    for a, b in wordhash.slices(offsets):
        w = wordhash.Words(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        count = np.diff(w.first)
        short = np.flatnonzero((count > 0) & (count < n))
        runs = wordhash.windows(w.hash, n)
        inside = np.repeat(w.first[1:], count)[: len(runs)] - np.arange(len(runs)) >= n
        own = np.where(count >= n, count - n + 1, 0)
        own[short] = 1
        at = np.concatenate(([0], np.cumsum(own)))
        out = np.zeros(at[-1], np.uint64)
        whole = np.ones(at[-1], bool)
        whole[at[short]] = False
        out[whole] = runs[inside]
        for k in short:
            out[at[k]] = wordhash.windows(w.hash[w.first[k] : w.first[k + 1]], int(count[k]))[0]
        yield a, b, out, at


def _signature(sh: np.ndarray, at: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """16-bit MinHash values of each row with shingles, tree by tree."""
    rng = np.random.Generator(np.random.Philox(77))
    flip = rng.integers(0, 1 << 64, trees * depth, dtype=np.uint64)
    turn = rng.integers(0, 1 << 63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    full = at[:-1][np.diff(at) > 0]
    out = np.zeros((len(full), trees * depth), "<u2")
    if len(full):
        with np.errstate(over="ignore"):
            for k in range(trees * depth):
                out[:, k] = wordhash.mix(np.minimum.reduceat((sh ^ flip[k]) * turn[k], full)) >> np.uint64(48)
    return out


def signatures(docs: DataFrame, trees: int, depth: int, threshold: float, recall: float) -> DataFrame:
    """doc_id, copy (digest of the text), size in bytes, values (binary, empty without shingles) and reach.

    ``reach`` is the prefix length at which a document's recall is reached.
    """
    reach = [depth] + [forest_depth(least_similarity(n, threshold), trees, depth, recall) for n in range(1, FEW + 1)] + [forest_depth(threshold, trees, depth, recall)]

    def run(batches):
        for batch in batches:
            out, stop = [], []
            for _, _, sh, at in shingles(batch.column(3)):
                values, k = _signature(sh, at, trees, depth), 0
                for x, y in zip(at.tolist(), at[1:].tolist(), strict=False):
                    out.append(values[k].tobytes() if y > x else b"")
                    stop.append(reach[len(set(sh[x:y].tolist()))] if y - x <= FEW else reach[-1])
                    k += y > x
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(out, pa.binary()), pa.array(stop, pa.int32())], ["doc_id", "copy", "size", "values", "reach"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.unhex(F.md5(text)).alias("copy"), F.octet_length(text).cast("long").alias("size"), text.alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, copy binary, size long, values binary, reach int")


def tries(nodes: DataFrame, trees: int, depth: int, floor: int) -> DataFrame:
    """(bucket, doc_id, low): runs of nodes that agree on ``floor`` values of a tree.

    ``low`` is the first node of the run of those that agree on all ``depth`` values.
    Runs at the ends of a partition may go on in the next one and are kept whatever
    their length.
    """
    kind = nodes.schema["doc_id"].dataType.simpleString()

    def leaves(batches):
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(-1, trees, depth)
            keys = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 2 * depth)
            tree = pa.array(np.tile(np.arange(trees, dtype=np.int32), batch.num_rows))
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), trees)))
            data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * depth), len(keys), [None, pa.py_buffer(keys.tobytes())])
            yield pa.RecordBatch.from_arrays([tree, data.cast(pa.binary()), ids], ["tree", "key", "doc_id"])

    def read(batches):
        held: list = []  # the open run: (doc_id, low)
        prefix, whole, low, first = None, None, None, True

        def close(last: bool):
            nonlocal first
            rows, held[:] = list(held), []
            keep = len(rows) > 1 or first or last
            first = False
            return [(prefix, *row) for row in rows] if keep else []

        for batch in batches:
            out = []
            for tree, key, doc in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                own = (tree, key[: 2 * floor])
                if own != prefix:
                    if held:
                        out += close(False)
                    prefix, whole = own, None
                if key != whole:
                    whole, low = key, doc
                held.append((doc, low))
                if len(held) >= 4096:  # an open run of any length goes out in parts
                    out += [(prefix, *row) for row in held]
                    del held[:]
                    first = True  # what is left of it is kept too
            yield table(out)
        if held:
            yield table(close(True))

    def table(out):
        names = [wordhash.mix(np.frombuffer(p[1][:8].ljust(8, b"\0"), np.uint64) ^ np.uint64(p[0] + 1))[0] for p, _, _ in out]
        return pa.RecordBatch.from_arrays([pa.array(np.array(names, np.uint64).view(np.int64)), pa.array([x for _, x, _ in out], id_type), pa.array([x for *_, x in out], id_type)], ["bucket", "doc_id", "low"])

    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    order = ["tree", "key", "doc_id"]
    rows = nodes.select("doc_id", "values").mapInArrow(leaves, f"tree int, key binary, doc_id {kind}")
    rows = rows.repartitionByRange(partitions(nodes.sparkSession), *order).sortWithinPartitions(*order)
    return rows.mapInArrow(read, f"bucket long, doc_id {kind}, low {kind}")


def shortened(nodes: DataFrame, rows: DataFrame, trees: int, depth: int, threshold: float) -> DataFrame:
    """(u, v): joins between groups whose nodes meet in a bucket of ``rows(bucket, doc_id, grp)``."""
    kind = nodes.schema["doc_id"].dataType.simpleString()
    mixed = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("grp").alias("a"), F.max("grp").alias("b")).filter("a <> b").select("bucket", "n")
    dealt = deal(rows, ["bucket"], mixed, "doc_id", 2 * BLOCK_ROWS).join(mixed, "bucket")
    units = 8 * partitions(nodes.sparkSession)
    dealt = dealt.withColumn("unit", F.when(F.col("n") <= SMALL, F.pmod("bucket", F.lit(units))).otherwise(F.xxhash64("bucket", "_bi", "_bj")))
    dealt = dealt.join(nodes.select("doc_id", "values", "reach"), "doc_id")
    least = agreement(threshold, trees * depth)

    def run(part: pa.Table) -> pa.Table:
        ids, bucket, reach, bi, bj = (part.column(c).to_numpy() for c in ("doc_id", "bucket", "reach", "_bi", "_bj"))
        names, group = np.unique(part.column("grp").to_numpy(), return_inverse=True)
        values = np.frombuffer(b"".join(part.column("values").to_pylist()), "<u2").reshape(len(ids), trees * depth)
        order = np.lexsort((ids, bj, bi, bucket))
        edges = np.flatnonzero(np.concatenate(([True], np.any([x[order][1:] != x[order][:-1] for x in (bucket, bi, bj)], axis=0), [True])))
        u, v = [names[:0]], [names[:0]]
        for low, high in zip(edges, edges[1:], strict=False):
            at = order[low:high]
            s, g, r = values[at], group[at], reach[at]
            if g.min() == g.max():
                continue
            left, right = [], []
            for a in range(0, len(at), 32):
                equal = s[a : a + 32, None, :] == s[None, :, :]
                ok = (equal.sum(axis=2) >= least) & (g[a : a + 32, None] != g[None, :])
                x, y = np.nonzero(ok)
                common = np.logical_and.accumulate(equal[x, y].reshape(-1, trees, depth), axis=2).sum(axis=2).max(axis=1)
                near = common >= np.maximum(r[a + x], r[y])
                left.append(a + x[near])
                right.append(y[near])
            own, place = np.unique(g, return_inverse=True)
            root = roots_of(len(own), place[np.concatenate(left)], place[np.concatenate(right)])
            hit = np.flatnonzero(root != np.arange(len(own)))
            u.append(names[own[hit]])
            v.append(names[own[root[hit]]])
        return pa.table({"u": np.concatenate(u), "v": np.concatenate(v)})

    return dealt.groupBy("unit").applyInArrow(run, f"u {kind}, v {kind}")


def candidate_groups(nodes: DataFrame, trees: int, depth: int, threshold: float, recall: float) -> DataFrame:
    """(doc_id, grp): nodes of the forest's runs, with the group that joins make of them."""
    runs = cut(tries(nodes, trees, depth, forest_depth(threshold, trees, depth, recall)))
    deep = runs.filter("doc_id <> low").select(F.col("doc_id").alias("u"), F.col("low").alias("v")).distinct()
    joined = connected_components(deep).select(F.col("node").alias("doc_id"), F.col("component").alias("grp"))
    rows = cut(runs.select("bucket", "doc_id").distinct().join(joined, "doc_id", "left").withColumn("grp", F.coalesce("grp", "doc_id")))
    return grouped(rows, shortened(nodes, rows, trees, depth, threshold), "doc_id")


def _confirmed(h: np.ndarray, equal) -> np.ndarray | None:
    """Numbers of values by hash if ``equal(i, j)`` holds for neighbours of one hash, else None."""
    order = np.argsort(h, kind="stable")
    new = np.concatenate(([True], h[order][1:] != h[order][:-1]))[: len(h)]
    again = np.flatnonzero(~new)
    if len(again) and not equal(order[again - 1], order[again]).all():
        return None
    out = np.empty(len(h), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def exact_sets(column: pa.Array, n: int = SHINGLE) -> list[np.ndarray]:
    """Each row's set of shingles as sorted numbers; numbers are equal only if all words are."""
    buf, offsets = wordhash.strings(column)
    w = wordhash.Words(buf, offsets)
    size = w.end - w.start

    def same_words(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok, step = size[i] == size[j], 1 << 18
        for k in range(0, len(i), step):
            x, y = i[k : k + step][ok[k : k + step]], j[k : k + step][ok[k : k + step]]
            if len(x):
                first = np.cumsum(size[x]) - size[x]
                ramp = np.arange(int(size[x].sum())) - np.repeat(first, size[x])
                equal = buf[np.repeat(w.start[x], size[x]) + ramp] == buf[np.repeat(w.start[y], size[y]) + ramp]
                ok[k : k + step][ok[k : k + step]] = np.logical_and.reduceat(equal, first)
        return ok

    word = _confirmed(w.hash, same_words)
    if word is None:
        data, numbers = buf.tobytes(), {}
        word = np.array([numbers.setdefault(data[a:b], len(numbers)) for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)], np.int64)
    count = np.diff(w.first)
    own = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    at = np.concatenate(([0], np.cumsum(own)))
    start = np.arange(at[-1]) - np.repeat(at[:-1], own) + np.repeat(w.first[:-1], own)
    end = np.repeat(w.first[1:], own)
    places = start[:, None] + np.arange(n)
    cells = np.where(places < end[:, None], word[np.minimum(places, max(0, len(word) - 1))], -1) if len(word) else np.zeros((0, n), np.int64)
    h = np.zeros(len(cells), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = wordhash.mix(h + cells[:, k].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    ids = _confirmed(h, lambda i, j: (cells[i] == cells[j]).all(axis=1))
    if ids is None:
        ids = np.unique(cells, axis=0, return_inverse=True)[1].ravel()
    return [np.unique(ids[x:y]) for x, y in zip(at, at[1:], strict=False)]


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    n = len(sets)
    of = np.repeat(np.arange(n), [len(s) for s in sets])
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = count[col] > 1
    of, col = of[keep], (np.cumsum(count > 1) - 1)[col[keep]]
    order = np.argsort(col, kind="stable")
    of, col = of[order], col[order]
    out, step = np.zeros((n, n), np.float32), 4096
    for low in range(0, int(col[-1]) + 1 if len(col) else 0, step):
        a, b = np.searchsorted(col, (low, low + step))
        m = np.zeros((n, step), np.float32)
        m[of[a:b], col[a:b] - low] = 1
        out += m @ m.T
    return out


def verify(docs: DataFrame, nodes: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """Exact links inside groups: (copy, n, u, v), n counting all copies of linked nodes, u and v ids of one class."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    members = cut(groups.join(nodes.select("doc_id", "copy", "mult", "size"), "doc_id"))
    sizes = members.groupBy("grp").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).filter("rows > 1")
    sizes = sizes.withColumn("n", F.greatest("rows", F.ceil(F.col("bytes") / BLOCK_BYTES) * BLOCK_ROWS))
    units = max(1, int(members.count()) // (BLOCK_ROWS // 2), partitions(docs.sparkSession))
    dealt = deal(members, ["grp"], sizes, "copy", BLOCK_ROWS).join(sizes.select("grp", "rows"), "grp")
    own = F.xxhash64("grp", "_bi", "_bj")
    dealt = dealt.withColumn("unit", F.when(F.col("rows") <= SMALL, F.pmod(F.xxhash64("grp"), F.lit(units))).otherwise(own))
    rows = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("copy"))
    texts = rows.join(dealt.select("doc_id", "copy", "grp", "mult", "unit", "_bi", "_bj", "_mine"), ["doc_id", "copy"])

    def run(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        ids, grp = part.column("doc_id").to_numpy(), part.column("grp").to_numpy()
        copy = np.array(part.column("copy").to_pylist(), object)
        bi, bj, mine = (part.column(c).to_numpy() for c in ("_bi", "_bj", "_mine"))
        mult = part.column("mult").to_numpy()
        texts = part.column("text").combine_chunks()
        out_copy, out_n, out_id, out_root = [], [], [ids[:0]], [ids[:0]]
        tag = np.unique(copy.astype("S16"), return_inverse=True)[1]
        order = np.lexsort((tag, bj, bi, grp))
        edges = np.flatnonzero(np.concatenate(([True], np.any([x[order][1:] != x[order][:-1] for x in (grp, bi, bj)], axis=0), [True])))
        for low, high in zip(edges, edges[1:], strict=False):
            at = order[low:high]
            at = at[np.concatenate(([True], tag[at][1:] != tag[at][:-1]))]  # repeated rows are one node
            if len(at) < 2:
                continue
            sets = exact_sets(texts.take(pa.array(at)))
            size = np.array([len(s) for s in sets])
            both = _overlaps(sets)
            near = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-6
            if bi[at[0]] != bj[at[0]]:
                near &= mine[at][:, None] != mine[at][None, :]
            np.fill_diagonal(near, False)
            near &= (size > 0)[:, None]
            n = near @ mult[at]
            a, b = np.nonzero(np.triu(near))
            by_id = np.argsort(ids[at], kind="stable")  # the root is the member with the smallest id
            place = np.empty(len(at), np.int64)
            place[by_id] = np.arange(len(at))
            root = by_id[roots_of(len(at), place[a], place[b])[place]]
            hit = np.flatnonzero(n)
            out_copy.extend(copy[at][hit])
            out_n.extend(n[hit].tolist())
            out_id.append(ids[at][hit])
            out_root.append(ids[at][root[hit]])
        return pa.table({"copy": pa.array(out_copy, pa.binary()), "n": pa.array(out_n, pa.int64()), "u": np.concatenate(out_id), "v": np.concatenate(out_root)})

    return texts.groupBy("unit").applyInArrow(run, f"copy binary, n long, u {kind}, v {kind}")


def _classes(docs: DataFrame, threshold: float, trees: int, recall: float) -> DataFrame:
    """(doc_id, copy, n_links, component_id, kept) of every row with an id."""
    sigs = cut(signatures(docs, trees, DEPTH, threshold, recall))
    nodes = sigs.filter(F.octet_length("values") > 0).groupBy("copy").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("mult"), *[F.min(c).alias(c) for c in ("size", "values", "reach")])
    nodes = cut(nodes)
    links = cut(verify(docs, nodes, candidate_groups(nodes, trees, DEPTH, threshold, recall), threshold))
    done = settle(nodes.select("doc_id", "copy", "mult"), links, "copy", "doc_id").select("copy", "mult", "n_direct", F.col("component").alias("_class"))
    rows = sigs.select("doc_id", "copy").join(done, "copy", "left")
    return rows.select(
        "doc_id", "copy",
        F.coalesce(F.col("n_direct") + F.col("mult") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("_class", "doc_id").alias("component_id"),
    ).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """doc_id, n_links, component_id and kept for every row."""
    lost = docs.filter(F.col("doc_id").isNull()).select("doc_id", F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return _classes(docs, threshold, trees, recall).drop("copy").union(lost)


def keep_one(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` without the later members of each class.

    Of several rows with a kept id the smallest stays, by text and then by the
    other columns; rows without an id stay.
    """
    gone = _classes(docs, THRESHOLD, TREES, RECALL).filter(~F.col("kept")).select("doc_id").distinct()
    rows = docs.filter(F.col("doc_id").isNotNull()).join(gone, "doc_id", "left_anti").select(F.col("doc_id").alias("_id"), F.struct("text", *[c for c in docs.columns if c != "text"]).alias("_row"))
    kept = rows.groupBy("_id").agg(F.min("_row").alias("_row"))
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns]).union(docs.filter(F.col("doc_id").isNull()))
