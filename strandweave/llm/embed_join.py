"""Embedding near-duplicates (operator 5): rotated binary codes with correction factors.

Each unit vector is turned by random rotations ``R`` and stored as

- a code: the signs of all rotated components, 512 bits or more; 16 bits at a time
  they are the bands that bring vectors together;
- its correction factors ``f = <x, R o>`` for the first ``ROUNDS`` rotations,
  where ``x = sign(R o) / sqrt(d)``;
- its rotated components in four bits each, for its part as a query, with the
  length of the rounding error.

``<x, R q> / f`` is an unbiased estimate of ``<o, q>`` over the rotations, and its
standard deviation is ``sqrt((1 - <o, q>^2) (1 - f^2) / f^2 / (d - 1))``; the mean
over ``ROUNDS`` rotations narrows it, the rounding error widens it. A pair needs an
exact recomputation if its estimate is not below the threshold by more than ``EPS``
deviations of a pair at the threshold.

1. ``deep``: vectors of a label that agree on two adjacent bands are joined at once.
2. ``bounded``: bands whose vectors are joined already are left out; in the others
   the stored codes and factors alone decide which vectors of different groups
   are joined. No vector travels for that.
3. ``verify``: joined vectors form groups, and every pair of a group is recomputed
   exactly, in double precision and bounded blocks; vectors travel once a block.

Steps 1 and 2 return a spanning set of joins, never pairs. Two vectors at cosine
0.98 share no band with probability 1.1e-6, more similar ones with less.

Equal vectors of a label are one node. Vectors that are null, zero, or hold null or
non-finite components, and rows without label or id, link with nothing. Vectors
of different lengths never link. Repeated rows count as copies. Rows with one id
and several vectors are compared by their own vectors and belong to one class,
since classes are made of ids. Only vec_id, embedding and label are read, so
other columns may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import deal, grouped, roots_of, settle
from .common import connected_components, cut, partitions

THRESHOLD = 0.98
BANDS, BITS = 32, 16
ROUNDS = 4  # rotations that estimates use
LEAST_DIM = 16  # shorter vectors are too few-sided for the bound: their pairs are all recomputed
EPS = 6.0
BLOCK_ROWS = 512
SMALL = 64  # buckets and groups of at most so many rows share units of work
SEED = 11


@lru_cache(maxsize=8)
def rotations(d: int, bits: int = BANDS * BITS) -> np.ndarray:
    """Random rotations of ``d`` dimensions, stacked until they give ``bits`` rows."""
    rng = np.random.Generator(np.random.Philox(SEED + d))
    count = -(-bits // d)
    out = []
    for _ in range(count):
        q, r = np.linalg.qr(rng.standard_normal((d, d)))
        out.append(q * np.sign(np.diag(r)))
    return np.concatenate(out)


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes (bytes), correction factors, four-bit queries (bytes) and (scale, squared rounding error) of unit vectors."""
    n, d = unit.shape
    turned = unit @ rotations(d).T
    signs = np.packbits(turned > 0, axis=1)
    k = min(ROUNDS, turned.shape[1] // d)
    own = turned[:, : k * d].reshape(n, k, d)
    factor = (np.abs(own).sum(axis=2) / np.sqrt(d)).astype("<f4")
    scale = np.maximum(np.abs(own).max(axis=(1, 2)), 1e-30) / 7.5
    level = np.clip(np.floor(own / scale[:, None, None]) + 8, 0, 15).astype(np.uint8)  # 16 cells, read at their middles
    error = ((own - (level - 7.5) * scale[:, None, None]) ** 2).sum(axis=(1, 2)) / k
    flat = level.reshape(n, -1)
    if flat.shape[1] % 2:
        flat = np.pad(flat, ((0, 0), (0, 1)))
    return signs, factor, flat[:, ::2] << 4 | flat[:, 1::2], np.stack([scale, error], axis=1).astype("<f4")


class Codes:
    """Stored codes of vectors of one length, ready for estimates."""

    def __init__(self, d: int, signs: np.ndarray, factor: np.ndarray, query: np.ndarray, spread: np.ndarray):
        n, k = factor.shape
        x = np.unpackbits(signs, axis=1)[:, : k * d].astype(np.float32) * 2 - 1
        self.d, self.factor = d, np.maximum(factor.astype(np.float64), 1e-6)
        self.code = x / (np.repeat(self.factor, d, axis=1) * k * np.sqrt(d)).astype(np.float32)
        level = np.stack([query >> 4, query & 15], axis=2).reshape(n, -1)[:, : k * d]
        self.query = (level.astype(np.float32) - 7.5) * spread[:, :1]
        self.error = spread[:, 1].astype(np.float64)

    def estimates(self, a: slice) -> np.ndarray:
        """Unbiased estimates of the products of vectors ``a`` (by code) with all (as queries)."""
        return self.code[a] @ self.query.T

    def least(self, a: slice, threshold: float, eps: float = EPS) -> np.ndarray:
        """Estimates below this are of pairs under the threshold, but for ``eps`` deviations."""
        f, k = self.factor[a], self.factor.shape[1]
        turn = (1 - threshold**2) * ((1 - f**2) / f**2).sum(axis=1) / max(1, self.d - 1) / k**2
        cell = (1 / f**2).sum(axis=1) / self.d / k**2
        return threshold - eps * np.sqrt(np.maximum(turn, 0)[:, None] + cell[:, None] * self.error[None, :])


def _rows(column: pa.Array) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for vectors that link with nothing."""
    out = []
    for v in column.to_pylist():
        a = None if v is None or any(c is None for c in v) else np.array(v, np.float64)
        if a is not None and a.size and np.isfinite(a).all() and (top := np.abs(a).max()) > 0:
            a = a / top  # squares of very large or small values stay finite
            out.append(a / np.linalg.norm(a))
        else:
            out.append(None)
    return out


def coded(vectors: DataFrame) -> DataFrame:
    """vec_id, label, unit (doubles as bytes) and the stored code; unit is null for vectors that link with nothing."""
    names = ["vec_id", "label", "unit", "code", "factor", "query", "spread"]

    def run(batches):
        for batch in batches:
            ok = [a and b for a, b in zip(batch.column(0).is_valid().to_pylist(), batch.column(1).is_valid().to_pylist(), strict=True)]
            units = [u if x else None for u, x in zip(_rows(batch.column(2)), ok, strict=True)]
            by_size: dict[int, list[int]] = {}
            for k, u in enumerate(units):
                if u is not None:
                    by_size.setdefault(len(u), []).append(k)
            out: list[list] = [[None] * batch.num_rows for _ in names[2:]]
            for own in by_size.values():
                x = np.stack([units[k] for k in own])
                for column, values in zip(out, (x, *encode(x)), strict=True):
                    for k, row in zip(own, np.ascontiguousarray(values), strict=True):
                        column[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.binary()) for c in out)], names)

    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, " + ", ".join(f"{c} binary" for c in names[2:])).withColumn("copy", F.md5(F.concat(F.encode(F.col("label").cast("string"), "UTF-8"), F.lit(b"\0"), "unit")))


def bands(nodes: DataFrame) -> DataFrame:
    """(vec_id, bucket, wide): one row for each band; buckets tell label, length, band and value.

    ``wide`` is the bucket of the band and the one beside it.
    """
    kind = nodes.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            codes = np.stack([np.frombuffer(x, ">u2", BANDS) for x in batch.column(1).to_pylist()]) if batch.num_rows else np.zeros((0, BANDS), ">u2")
            value = codes.astype(np.int32)
            both = (value[:, ::2].astype(np.int64) << BITS) | value[:, 1::2]
            take = lambda n: pa.array(np.repeat(np.arange(batch.num_rows), n))
            band = np.tile(np.arange(BANDS, dtype=np.int32), len(value))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take(BANDS)), batch.column(2).take(take(BANDS)), pa.array(band), pa.array(value.ravel()), pa.array(np.repeat(both, 2, axis=1).ravel())], ["vec_id", "grp", "band", "value", "both"])

    rows = nodes.select("vec_id", "code", F.xxhash64("label", F.octet_length("unit")).alias("grp")).mapInArrow(run, f"vec_id {kind}, grp long, band int, value int, both long")
    return rows.select("vec_id", F.xxhash64("grp", "band", "value").alias("bucket"), F.when(F.col("band") % 2 == 0, F.xxhash64("grp", F.col("band") + BANDS, "both")).alias("wide"))


def deep(rows: DataFrame) -> DataFrame:
    """(vec_id, grp) of vectors that agree on two adjacent bands with another."""
    wide = rows.filter("wide is not null").select("wide", "vec_id")
    low = wide.groupBy("wide").agg(F.min("vec_id").alias("low"), F.count("*").alias("n")).filter("n > 1")
    joined = connected_components(wide.join(low, "wide").select(F.col("vec_id").alias("u"), F.col("low").alias("v")))
    return joined.select(F.col("node").alias("vec_id"), F.col("component").alias("grp"))


def bounded(nodes: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """(u, v): joins between groups that meet in a bucket of ``rows(bucket, vec_id, grp)``.

    Estimates and bounds from stored codes decide; ``n_undecided`` counts the pairs
    behind the joins.
    """
    kind = nodes.schema["vec_id"].dataType.simpleString()
    mixed = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("grp").alias("a"), F.max("grp").alias("b")).filter("a <> b").select("bucket", "n")
    dealt = deal(rows, ["bucket"], mixed, "vec_id", BLOCK_ROWS).join(mixed, "bucket").join(nodes.select("vec_id", "label", F.octet_length("unit").alias("bytes"), "code", "factor", "query", "spread"), "vec_id")
    unit = F.when(F.col("n") <= SMALL, F.pmod("bucket", F.lit(8 * partitions(nodes.sparkSession)))).otherwise(F.xxhash64("bucket", "_bi", "_bj"))

    def run(part: pa.Table) -> pa.Table:
        ids, bucket, bi, bj, size = (part.column(c).to_numpy() for c in ("vec_id", "bucket", "_bi", "_bj", "bytes"))
        names, group = np.unique(part.column("grp").to_numpy(), return_inverse=True)
        label = np.unique(part.column("label").to_pylist(), return_inverse=True)[1]
        store = {c: part.column(c).to_pylist() for c in ("code", "factor", "query", "spread")}
        order = np.lexsort((ids, bj, bi, size, label, bucket))
        edge = np.flatnonzero(np.concatenate(([True], np.any([x[order][1:] != x[order][:-1] for x in (bucket, label, size, bi, bj)], axis=0), [True])))
        u, v, total = [names[:0]], [names[:0]], [0]
        for low, high in zip(edge, edge[1:], strict=False):
            at = order[low:high]
            g, d = group[at], int(size[at[0]]) // 8
            if len(at) < 2 or g.min() == g.max():
                continue
            read = lambda c, t, at=at: np.stack([np.frombuffer(store[c][k], t) for k in at])
            c = Codes(d, read("code", np.uint8), read("factor", "<f4"), read("query", np.uint8), read("spread", "<f4"))
            near = np.ones((len(at), len(at)), bool)
            for a in range(0, len(at), 128) if d >= LEAST_DIM else ():
                s = slice(a, a + 128)
                near[s] = c.estimates(s) >= c.least(s, threshold)
            near &= g[:, None] != g[None, :]
            x, y = np.nonzero(np.triu(near | near.T, 1))
            own, place = np.unique(g, return_inverse=True)
            root = roots_of(len(own), place[x], place[y])
            hit = np.flatnonzero(root != np.arange(len(own)))
            u.append(names[own[hit]])
            v.append(names[own[root[hit]]])
            total.append(len(x))
        u, v = np.concatenate(u), np.concatenate(v)
        return pa.table({"u": u, "v": v, "n_undecided": pa.array(([sum(total)] + [0] * (len(u) - 1))[: len(u)], pa.int64())})

    return dealt.withColumn("task", unit).groupBy("task").applyInArrow(run, f"u {kind}, v {kind}, n_undecided long")


def verify(nodes: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """Exact links inside groups: (copy, n, u, v), n counting all copies of linked nodes, u and v ids of one class."""
    kind = nodes.schema["vec_id"].dataType.simpleString()
    members = cut(groups.join(nodes.select("vec_id", "copy", "mult"), "vec_id"))
    sizes = members.groupBy("grp").agg(F.count("*").alias("n")).filter("n > 1")
    units = max(1, int(members.count()) // (BLOCK_ROWS // 2), partitions(nodes.sparkSession))
    dealt = deal(members, ["grp"], sizes, "copy", BLOCK_ROWS).join(sizes, "grp").join(nodes.select("copy", "label", "unit"), "copy")
    unit = F.when(F.col("n") <= SMALL, F.pmod(F.xxhash64("grp"), F.lit(units))).otherwise(F.xxhash64("grp", "_bi", "_bj"))

    def run(part: pa.Table) -> pa.Table:
        ids, grp, mult, bi, bj, mine = (part.column(c).to_numpy() for c in ("vec_id", "grp", "mult", "_bi", "_bj", "_mine"))
        copy, blob = part.column("copy").to_pylist(), part.column("unit").to_pylist()
        label = np.unique(part.column("label").to_pylist(), return_inverse=True)[1]
        size = np.array([len(x) for x in blob])
        order = np.lexsort((ids, bj, bi, size, label, grp))
        edge = np.flatnonzero(np.concatenate(([True], np.any([x[order][1:] != x[order][:-1] for x in (grp, label, size, bi, bj)], axis=0), [True])))
        out_copy, out_n, out_id, out_root = [], [], [ids[:0]], [ids[:0]]
        for low, high in zip(edge, edge[1:], strict=False):
            at = order[low:high]
            if len(at) < 2:
                continue
            x = np.stack([np.frombuffer(blob[k]) for k in at])
            near = np.triu(x @ x.T >= threshold - 1e-9, 1)
            if bi[at[0]] != bj[at[0]]:
                near &= mine[at][:, None] != mine[at][None, :]
            left, right = np.nonzero(near)
            exact = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", x[left[k : k + 65536]], x[right[k : k + 65536]]) for k in range(0, len(left), 65536))])
            left, right = left[exact >= threshold], right[exact >= threshold]
            n = np.bincount(left, mult[at][right], len(at)) + np.bincount(right, mult[at][left], len(at))
            root = roots_of(len(at), left, right)  # members are in id order
            hit = np.flatnonzero(n)
            out_copy.extend(copy[at[k]] for k in hit)
            out_n.extend(n[hit].astype(np.int64).tolist())
            out_id.append(ids[at][hit])
            out_root.append(ids[at][root[hit]])
        return pa.table({"copy": pa.array(out_copy, pa.string()), "n": pa.array(out_n, pa.int64()), "u": np.concatenate(out_id), "v": np.concatenate(out_root)})

    return dealt.withColumn("task", unit).groupBy("task").applyInArrow(run, f"copy string, n long, u {kind}, v {kind}")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row."""
    codes = cut(coded(vectors))
    nodes = codes.filter("unit is not null").groupBy("copy").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("mult"), *[F.min(c).alias(c) for c in ("label", "unit", "code", "factor", "query", "spread")])
    nodes = cut(nodes)
    rows = bands(nodes)
    rows = cut(rows.select("vec_id", "bucket").join(deep(rows), "vec_id", "left").withColumn("grp", F.coalesce("grp", "vec_id")))
    links = cut(verify(nodes, grouped(rows, bounded(nodes, rows, threshold), "vec_id"), threshold))
    done = settle(nodes.select("vec_id", "copy", "mult"), links, "copy", "vec_id").select("copy", "mult", "n_direct", F.col("component").alias("_class"))
    return (
        codes.select("vec_id", "copy")
        .join(done, "copy", "left")
        .select(
            "vec_id",
            F.coalesce(F.col("n_direct") + F.col("mult") - 1, F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("_class", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
