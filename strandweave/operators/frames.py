"""Haplotype-graph stages as DataFrames, for graphs too large for one task to build."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import dp
from .expanded import HapGraph
from .ids import dense_ids


def copies(steps: DataFrame) -> DataFrame:
    """(x, walk_id, pos, seg_id): one node for each step; 0 is the source."""
    return dense_ids(steps.select("walk_id", "pos", "seg_id"), ["walk_id", "pos"], "x", start=1)


def chain_edges(nodes: DataFrame) -> DataFrame:
    """(u, v, w): along walks, from the source 0, and to the sink -1."""
    w = Window.partitionBy("walk_id").orderBy("pos")
    e = nodes.select("x", F.lead("x").over(w).alias("nxt"), F.lag("x").over(w).alias("prev"))
    zero = F.lit(0).cast("long")
    inner = e.select(F.col("x").alias("u"), F.coalesce("nxt", F.lit(-1).cast("long")).alias("v"))
    return inner.union(e.filter("prev is null").select(zero, "x")).withColumn("w", F.lit(0))


def switches(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(walk_id, pos, u, v): graph edges that leave a step other than along its walk."""
    w = Window.partitionBy("walk_id").orderBy("pos")
    s = steps.withColumn("nxt", F.lead("seg_id").over(w))
    out = s.join(edges.select(F.col("u").alias("seg_id"), "v").distinct(), "seg_id")
    return out.filter("nxt is null or nxt <> v").select("walk_id", "pos", F.col("seg_id").alias("u"), "v")


def recombination_nodes(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(u, v, n_in, n_out): one node for each switched edge; in: weight 1, out: weight 0."""
    n_in = switches(steps, edges).groupBy("u", "v").agg(F.count("*").alias("n_in"))
    n_out = steps.groupBy(F.col("seg_id").alias("v")).agg(F.count("*").alias("n_out"))
    return n_in.join(n_out, "v", "left").select("u", "v", "n_in", F.coalesce("n_out", F.lit(0).cast("long")).alias("n_out"))


def super_nodes(anchors: DataFrame) -> DataFrame:
    """Anchors that span several vertices: (walk_id, at, key, first, last, n)."""
    n = F.size("vtxs")
    return anchors.filter(n > 1).select("walk_id", "at", "key", F.element_at("vtxs", 1).alias("first"), F.element_at("vtxs", -1).alias("last"), n.cast("long").alias("n"))


def containments(anchors: DataFrame) -> DataFrame:
    """(walk_id, key, at, n): anchors whose vertices lie within another anchor's, with how many do.

    Ends are compared as intervals of vertices on one walk. An interval is dealt
    to every tile it covers and the inner one only to its first, so the join is
    an equi-join on (walk, tile).
    """
    tile = 64
    a = anchors.select("walk_id", "key", "at", F.element_at("vtxs", 1).alias("lo"), F.element_at("vtxs", -1).alias("hi"))
    outer = a.withColumn("tile", F.explode(F.sequence(F.expr(f"lo div {tile}"), F.expr(f"hi div {tile}"))))
    outer = outer.select("walk_id", "tile", F.col("lo").alias("olo"), F.col("hi").alias("ohi"), F.col("key").alias("okey"), F.col("at").alias("oat"))
    inner = a.withColumn("tile", F.expr(f"lo div {tile}"))
    hit = (F.col("olo") <= F.col("lo")) & (F.col("hi") <= F.col("ohi")) & ((F.col("okey") != F.col("key")) | (F.col("oat") != F.col("at")))
    return inner.join(outer, ["walk_id", "tile"]).filter(hit).groupBy("walk_id", "key", "at").agg(F.count("*").alias("n"))


def colour_ids(anchors: DataFrame) -> DataFrame:
    """(key, color): numbered in key order over keys with an occurrence."""
    return dense_ids(anchors.select("key").distinct(), ["key"], "color")


def colours_on_path(occurrences: DataFrame, path: str, color: str) -> DataFrame:
    """(path, colors, ratio): distinct colours of each path and how often one occurs on average."""
    per = occurrences.groupBy(path, color).agg(F.count("*").alias("n"))
    return per.groupBy(path).agg(F.count("*").alias("colors"), F.avg("n").alias("ratio"))


def elbows(curves: DataFrame, degrees: float = dp.ELBOW_DEGREES) -> DataFrame:
    """(grp, best) of curves (grp, r, distinct): first budget whose gain falls under the angle, else 0."""
    w = Window.partitionBy("grp").orderBy("r")
    d = curves.select("grp", "r", (F.lead("distinct").over(w) - F.col("distinct")).alias("gain"))
    top = d.groupBy("grp").agg(F.max(F.abs("gain")).alias("top"))
    small = (F.col("top") > 0) & (F.degrees(F.atan(F.col("gain") / F.col("top"))) < degrees)
    return d.join(top, "grp").groupBy("grp").agg(F.coalesce(F.min(F.when(small, F.col("r"))), F.lit(0)).cast("long").alias("best"))


def certificates(counts: DataFrame) -> DataFrame:
    """(grp, objective, m_hom, m_het) of pairs of paths, from (grp, color, hom, k1, k2).

    ``k1`` and ``k2`` are a colour's occurrences on the two paths; parts that would
    divide by zero are null.
    """
    shared = F.col("hom") & (F.col("k1") > 0) & (F.col("k2") > 0)
    single = ~F.col("hom") & ((F.col("k1") > 0) != (F.col("k2") > 0))
    n = lambda x: F.count(F.when(x, 1))
    return counts.groupBy("grp").agg(
        (n(shared) + n(single)).alias("objective"),
        F.avg(F.when(shared, F.greatest("k1", "k2"))).alias("m_hom"),
        F.avg(F.when(single, F.col("k1") + F.col("k2"))).alias("m_het"),
    )


def weighted_edges(edges: DataFrame, by: str) -> DataFrame:
    """(by, n): edges that cost a switch."""
    return edges.groupBy(by).agg(F.count(F.when(F.col("w") > 0, 1)).alias("n"))


def dummies(levels: DataFrame, edges: DataFrame) -> DataFrame:
    """(u, v, level): one dummy for each level an edge skips."""
    a = levels.select(F.col("seg_id").alias("u"), F.col("col").alias("lu"))
    b = levels.select(F.col("seg_id").alias("v"), F.col("col").alias("lv"))
    e = edges.select("u", "v").distinct().join(a, "u").join(b, "v").filter("lv - lu > 1")
    return e.select("u", "v", F.explode(F.sequence(F.col("lu") + 1, F.col("lv") - 1)).alias("level"))


def widths(levels: DataFrame, gaps: DataFrame) -> DataFrame:
    """(level, n): nodes and dummies of every level."""
    return levels.select(F.col("col").alias("level")).union(gaps.select("level")).groupBy("level").agg(F.count("*").alias("n"))


def pair_scores(edges: DataFrame, colors: DataFrame, hom: DataFrame) -> DataFrame:
    """(u1, v1, u2, v2, hom_shared, het_single) for all pairs of edges between two levels.

    ``edges`` are (level, u, v); ``colors`` (x, cs); ``hom`` (c). Levels are
    narrow, so the pair table is a join on the level.
    """
    homs = hom.agg(F.array_sort(F.collect_list("c")).alias("homs"))
    parts = colors.crossJoin(F.broadcast(homs)).select("x", F.array_intersect("cs", "homs").alias("h"), F.array_except("cs", "homs").alias("t"))
    end = lambda n, a, b: parts.select(F.col("x").alias(n), F.col("h").alias(a), F.col("t").alias(b))
    one = edges.select("level", F.col("u").alias("u1"), F.col("v").alias("u2")).join(end("u1", "h1", "t1"), "u1").join(end("u2", "h2", "t2"), "u2")
    two = edges.select("level", F.col("u").alias("v1"), F.col("v").alias("v2")).join(end("v1", "g1", "s1"), "v1").join(end("v2", "g2", "s2"), "v2")
    t_now, t_next = F.array_union("t1", "s1"), F.array_union("t2", "s2")
    return one.join(two, "level").select(
        "u1", "v1", "u2", "v2",
        F.size(F.array_intersect(F.array_union("h1", "g1"), F.array_union("h2", "g2"))).cast("long").alias("hom_shared"),
        (F.size(F.array_except(t_now, t_next)) + F.size(F.array_except(t_next, t_now))).cast("long").alias("het_single"),
    )


def solve(nodes: DataFrame, edges: DataFrame, budget: int, mode: str = "as_coded", full_path: bool = True) -> DataFrame:
    """(grp, r, haploid, diploid): best scores of levelled graphs, one task for each ``grp``.

    ``nodes`` are (grp, x, level, cs, homs) and ``edges`` (grp, u, v, w), every
    edge spanning one level; the source is the only node of level 0, the sink the
    only one of the last. Scores out of reach are null.
    """

    def run(part: pa.Table) -> pa.Table:
        rows = part.to_pylist()
        own = sorted((r for r in rows if r["v"] is None), key=lambda r: (r["level"], r["x"]))
        at = {r["x"]: i for i, r in enumerate(own)}
        g, hom = HapGraph(), {}
        for r in own:
            g.level.append(r["level"])
            g.colors[g.node(0, [r["x"]])] = sorted(r["cs"])
            hom.update({c: c in r["homs"] for c in r["cs"]})
        for r in sorted((r for r in rows if r["v"] is not None), key=lambda r: (r["x"], r["v"])):
            g.out[at[r["x"]]].append((at[r["v"]], r["w"]))
        g.source, g.sink = 0, len(own) - 1
        one = dp.haploid(g, budget, full_path).value
        two = dp.diploid(g, budget, [hom.get(c, False) for c in range(max(hom, default=-1) + 1)], mode).value
        clean = lambda v: None if v < 0 else v
        n = budget + 1
        return pa.table({"grp": pa.array([rows[0]["grp"]] * n, pa.int64()), "r": pa.array(range(n), pa.int32()), "haploid": pa.array(map(clean, one), pa.int64()), "diploid": pa.array(map(clean, two), pa.int64())})

    none_a = F.lit(None).cast("array<int>")
    rows = nodes.select("grp", "x", "level", F.lit(None).cast("long").alias("v"), F.lit(0).alias("w"), "cs", "homs").union(edges.select("grp", "u", F.lit(None).cast("int"), "v", "w", none_a, none_a))
    return rows.groupBy("grp").applyInArrow(run, "grp long, r int, haploid long, diploid long")
