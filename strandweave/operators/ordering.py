"""Columns of vertices: positions that increase along every walk."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ids import dense_ids
from .lineage import cut

KERNEL = 2_000_000  # vertices that one task holds with ease


def seed_columns(steps: DataFrame, vertices: DataFrame) -> DataFrame:
    """(seg_id, col): earliest index on any walk; vertices on no walk come last."""
    first = steps.groupBy("seg_id").agg(F.min("pos").alias("col"))
    last = steps.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("_end"))
    return vertices.select("seg_id").join(first, "seg_id", "left").crossJoin(F.broadcast(last)).select("seg_id", F.coalesce("col", "_end").cast("long").alias("col"))


def consecutive(steps: DataFrame) -> DataFrame:
    """Distinct consecutive steps (u, v)."""
    w = Window.partitionBy("walk_id").orderBy("pos")
    return steps.withColumn("v", F.lead("seg_id").over(w)).filter("v is not null").select(F.col("seg_id").alias("u"), "v").distinct()


def relaxed(col: dict[int, int], out: dict[int, list[int]], sweeps: int) -> dict[int, int]:
    """Columns raised until every edge climbs, by rounds in which all raised vertices push at once.

    Without a cycle, and with rounds enough, that ends where one pass in topological
    order does; otherwise the rounds themselves are counted.
    """
    left = dict.fromkeys(col, 0)
    for row in out.values():
        for v in row:
            left[v] += 1
    queue, done, top = deque(u for u, n in left.items() if not n), 0, dict(col)
    while queue and sweeps >= len(col):
        u = queue.popleft()
        done += 1
        for v in out.get(u, ()):
            top[v] = max(top[v], top[u] + 1)
            left[v] -= 1
            if not left[v]:
                queue.append(v)
    if done == len(col):
        return top
    front = col
    for _ in range(sweeps):
        pushed: dict[int, int] = {}
        for u, c in front.items():
            for v in out.get(u, ()):
                if c + 1 > pushed.get(v, col[v]):
                    pushed[v] = c + 1
        if not pushed:
            break
        col, front = {**col, **pushed}, pushed
    return col


def relax(columns: DataFrame, pairs: DataFrame, sweeps: int | None = None) -> DataFrame:
    """Raise columns until col(v) > col(u) for every pair; a cap on rounds ends cycles.

    In a round every vertex raised by the one before pushes its successors. A graph
    of up to ``KERNEL`` vertices is one unit of work; a larger one is relaxed by joins,
    with the same rounds and the same result.
    """
    total = columns.count()
    if total > KERNEL:
        return relax_by_rounds(columns, pairs, sweeps or max(10, total))
    none = F.lit(None).cast("long")
    rows = columns.select(F.lit(0).alias("g"), F.col("seg_id").cast("long").alias("u"), none.alias("v"), F.col("col").cast("long").alias("c"))
    rows = rows.union(pairs.select(F.lit(0), F.col("u").cast("long"), F.col("v").cast("long"), none))

    def run(part: pa.Table) -> pa.Table:
        col, out = {}, {}
        for u, v, c in zip(*(part.column(x).to_pylist() for x in ("u", "v", "c")), strict=True):
            if v is None:
                col[u] = c
            else:
                out.setdefault(u, []).append(v)
        col = relaxed(col, out, sweeps or max(10, total))
        return pa.table({"seg_id": pa.array(col.keys(), pa.int64()), "col": pa.array(col.values(), pa.int64())})

    return rows.groupBy("g").applyInArrow(run, "seg_id long, col long")


def relax_by_rounds(columns: DataFrame, pairs: DataFrame, sweeps: int) -> DataFrame:
    """The same by joins: a round pushes only what the one before it raised."""
    pairs = cut(pairs)
    state, front = cut(columns), None
    for _ in range(sweeps):
        source = state if front is None else front
        pushed = source.join(pairs, source.seg_id == pairs.u).groupBy("v").agg((F.max("col") + 1).alias("new"))
        raised = cut(state.join(pushed, state.seg_id == pushed.v).filter(F.col("new") > F.col("col")).select("seg_id", "new"))
        if raised.isEmpty():
            break
        state = cut(state.join(raised, "seg_id", "left").select("seg_id", F.coalesce("new", "col").alias("col")))
        front = raised.select("seg_id", F.col("new").alias("col"))
    return state


def dense_columns(columns: DataFrame) -> DataFrame:
    """(seg_id, col, rank): columns numbered without gaps; rank by (col, seg_id)."""
    used = dense_ids(columns.select("col").distinct(), ["col"], "dense")
    out = columns.join(used, "col").select("seg_id", F.col("dense").alias("col"))
    return dense_ids(out, ["col", "seg_id"], "rank")


def skip_edges(steps: DataFrame, columns: DataFrame) -> DataFrame:
    """Consecutive steps that cross more than one column."""
    a = columns.select(F.col("seg_id").alias("u"), F.col("col").alias("cu"))
    b = columns.select(F.col("seg_id").alias("v"), F.col("col").alias("cv"))
    return consecutive(steps).join(a, "u").join(b, "v").filter("cv - cu > 1").select("u", "v")


def sorted_adjacency(edges: DataFrame, columns: DataFrame) -> DataFrame:
    """(u, out): targets of every vertex by (column, id)."""
    c = columns.select(F.col("seg_id").alias("v"), "col")
    return edges.join(c, "v").groupBy("u").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "v"))), lambda x: x["v"]).alias("out"))


def levels(edges: DataFrame) -> DataFrame:
    """(seg_id, col): longest path from a source of an acyclic graph."""
    nodes = edges.select(F.col("u").alias("seg_id")).union(edges.select("v")).distinct()
    return relax(nodes.withColumn("col", F.lit(0).cast("long")), edges.select("u", "v").distinct())
