"""Graph normalisation as relational operators.

Segments carry ``seg_id`` and ``len``; arcs are directed (v, w) over vertices
``2 * seg_id + strand``, with overlaps ``ov`` (at v's end) and ``ow``, a ``rank``
and ``link_id``; ``comp`` marks an arc added as a complement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.gfa import MISSING
from .ids import dense_ids


def mate(v: Column) -> Column:
    """The same segment on the other strand."""
    return F.lit(1).bitwiseXOR(v)


def segment_ids(segments: DataFrame, links: DataFrame) -> DataFrame:
    """(name, seg_id, line): ids by first appearance in any S or L line."""
    seen = (
        segments.select("name", "line", F.lit(0).alias("field"))
        .union(links.select("from_name", "line", F.lit(1)))
        .union(links.select("to_name", "line", F.lit(2)))
        .groupBy("name")
        .agg(F.min(F.struct("line", "field")).alias("at"))
        .select("name", "at.line", "at.field")
    )
    return dense_ids(seen, ["line", "field"], "seg_id").select("name", "seg_id", "line")


def link_lengths(links: DataFrame) -> DataFrame:
    """(name, least): a segment's length as its links' L1 and L2 tags and overlaps imply it."""
    one = links.filter(F.col("l1").isNotNull() & (F.col("ov") != MISSING)).select(F.col("from_name").alias("name"), (F.col("ov") + F.col("l1")).alias("least"))
    two = links.filter(F.col("l2").isNotNull() & (F.col("ow") != MISSING)).select(F.col("to_name").alias("name"), (F.col("ow") + F.col("l2")).alias("least"))
    return one.union(two).groupBy("name").agg(F.max("least").alias("least"))


def encode_segments(segments: DataFrame, links: DataFrame) -> DataFrame:
    """Segments with ids; names that only links mention have the length that links imply, or 0.

    ``first_line`` is the line of the first S or L record with the name.
    """
    ids = segment_ids(segments, links)
    first = segments.groupBy("name").agg(F.min_by(F.struct("seq", "len", "sn", "so", "sr"), "line").alias("s"))
    out = ids.join(first, "name", "left")
    size = F.coalesce("s.len", F.lit(0))
    if {"l1", "l2"} <= set(links.columns):
        out = out.join(link_lengths(links), "name", "left")
        size = F.greatest(size, F.coalesce("least", F.lit(0)))
    return out.select("seg_id", "name", "s.seq", size.cast("int").alias("len"), "s.sn", "s.so", "s.sr", F.col("line").alias("first_line"))


def arcs_of(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Directed arcs of links by segment name."""
    a = ids.select(F.col("name").alias("from_name"), F.col("seg_id").alias("_a"))
    b = ids.select(F.col("name").alias("to_name"), F.col("seg_id").alias("_b"))
    return links.join(a, "from_name").join(b, "to_name").select(
        (F.col("_a") * 2 + F.col("from_rev").cast("long")).alias("v"), (F.col("_b") * 2 + F.col("to_rev").cast("long")).alias("w"),
        "ov", "ow", F.coalesce("rank", F.lit(-1)).alias("rank"), F.col("line").alias("link_id"), F.lit(False).alias("comp"),
    )


def stable_sequences(segments: DataFrame) -> DataFrame:
    """Extent and rank of every stable sequence."""
    s = segments.filter("sn is not null")
    return s.groupBy("sn").agg(F.min("so").alias("min_so"), F.max(F.col("so") + F.col("len")).alias("max_so"), F.min_by("sr", "seg_id").alias("rank"))


def defined(segments: DataFrame) -> DataFrame:
    return segments.filter("len > 0")


def undefined(segments: DataFrame) -> DataFrame:
    return segments.filter("len = 0")


def sort_arcs(arcs: DataFrame, segments: DataFrame) -> DataFrame:
    """Arcs clustered by v and sorted by (v, lv), lv being the length before the overlap."""
    out = arcs if "lv" in arcs.columns else clip(arcs, segments)
    return out.repartition("v").sortWithinPartitions("v", "lv")


def fill_overlaps(arcs: DataFrame) -> DataFrame:
    """Take a missing overlap from the only complement arc; without exactly one the arc goes."""
    back = arcs.select(mate(F.col("w")).alias("v"), mate(F.col("v")).alias("w"), F.col("ow").alias("_ov"), F.col("ov").alias("_ow"))
    one = back.groupBy("v", "w").agg(F.count("*").alias("_n"), F.first("_ov").alias("_ov"), F.first("_ow").alias("_ow"))
    lack = (F.col("ov") == MISSING) | (F.col("ow") == MISSING)
    joined = arcs.join(one, ["v", "w"], "left").filter(~lack | (F.col("_n") == 1))
    pick = lambda a, b: F.when(F.col(a) == MISSING, F.col(b)).otherwise(F.col(a)).alias(a)
    out = joined.select("v", "w", pick("ov", "_ov"), pick("ow", "_ow"), "rank", "link_id", "comp")
    return out.filter((F.col("ov") != MISSING) & (F.col("ow") != MISSING))


def add_complements(arcs: DataFrame) -> DataFrame:
    """Every arc v -> w gets its mate w' -> v' unless it is there."""
    turned = arcs.select(mate(F.col("w")).alias("v"), mate(F.col("v")).alias("w"), F.col("ow").alias("ov"), F.col("ov").alias("ow"), "rank", "link_id", F.lit(True).alias("comp"))
    # a palindromic arc is its own complement
    new = turned.join(arcs.select("v", "w").distinct(), ["v", "w"], "left_anti")
    return arcs.select(*turned.columns).union(new)


def clip(arcs: DataFrame, segments: DataFrame) -> DataFrame:
    """Overlaps within segment lengths, ``lv``; arcs of undefined segments go."""
    size = defined(segments).select("seg_id", "len")
    a = size.select(F.col("seg_id").alias("_a"), F.col("len").alias("_la"))
    b = size.select(F.col("seg_id").alias("_b"), F.col("len").alias("_lb"))
    out = arcs.join(a, F.expr("v div 2") == F.col("_a")).join(b, F.expr("w div 2") == F.col("_b"))
    return out.select("v", "w", F.least("ov", "_la").alias("ov"), F.least("ow", "_lb").alias("ow"), (F.col("_la") - F.least("ov", "_la")).alias("lv"), "rank", "link_id", "comp")


def normalise(arcs: DataFrame, segments: DataFrame) -> DataFrame:
    """The fixed order: undefined segments, overlaps, complements, lengths."""
    ok = defined(segments).select("seg_id")
    keep = arcs.join(ok, F.expr("v div 2") == ok.seg_id, "left_semi").join(ok, F.expr("w div 2") == ok.seg_id, "left_semi")
    return clip(add_complements(fill_overlaps(keep)), segments)


def multi_edges(arcs: DataFrame) -> DataFrame:
    """(v, w, n) of parallel arcs."""
    return arcs.groupBy("v", "w").agg(F.count("*").alias("n")).filter("n > 1")


def single_edges(arcs: DataFrame) -> DataFrame:
    """One arc for each (v, w): lowest rank, then first link."""
    w = Window.partitionBy("v", "w").orderBy("rank", "link_id", "comp")
    return arcs.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def find_arc(arcs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(v, w, link): the arc's link_id, -1 for none, -2 for several."""
    hits = arcs.groupBy("v", "w").agg(F.count("*").alias("n"), F.first("link_id").alias("link_id"))
    return pairs.join(hits, ["v", "w"], "left").select("v", "w", F.when(F.col("n").isNull(), -1).when(F.col("n") > 1, -2).otherwise(F.col("link_id")).cast("long").alias("link"))


def delete_segments(segments: DataFrame, arcs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments and arcs without the segments in ``gone(seg_id)``."""
    kept = arcs.join(gone, F.expr("v div 2") == gone.seg_id, "left_anti").join(gone, F.expr("w div 2") == gone.seg_id, "left_anti")
    return segments.join(gone, "seg_id", "left_anti"), kept


def walk_table(walks: DataFrame, ids: DataFrame) -> DataFrame:
    """(walk_id, pos, seg_id, rev) of walks (walk_id, steps); unknown segments are skipped.

    If the walks have their ``line`` and the ids a ``first_line``, a segment is known
    only from the line on that first names it.
    """
    ordered = "line" in walks.columns and "first_line" in ids.columns
    line = F.col("line") if ordered else F.lit(1).cast("long")
    flat = walks.select("walk_id", line.alias("_line"), F.posexplode("steps").alias("at", "s")).select("walk_id", "_line", "at", F.col("s.name").alias("name"), F.col("s.rev").alias("rev"))
    first = F.col("first_line") if ordered else F.lit(0).cast("long")
    known = flat.join(ids.select("name", "seg_id", first.alias("_first")), "name").filter("_first < _line")
    w = Window.partitionBy("walk_id").orderBy("at")
    return known.select("walk_id", (F.row_number().over(w) - 1).alias("pos"), "seg_id", "rev")


def flip_walks(steps: DataFrame) -> DataFrame:
    """Reverse walks that mostly disagree with the strands of first occurrence.

    A segment's reference strand is that of its first step over all walks. A walk
    with strictly more disagreeing than agreeing steps is reversed: order and
    strands. Adds ``flipped``.
    """
    ref = steps.groupBy("seg_id").agg(F.min_by("rev", F.struct("walk_id", "pos")).alias("_ref"))
    vote = steps.join(ref, "seg_id").groupBy("walk_id").agg(F.sum(F.when(F.col("rev") == F.col("_ref"), -1).otherwise(1)).alias("_vote"), F.max("pos").alias("_last"))
    out = steps.join(vote, "walk_id").withColumn("flipped", F.col("_vote") > 0)
    return out.select("walk_id", F.when(F.col("flipped"), F.col("_last") - F.col("pos")).otherwise(F.col("pos")).alias("pos"), "seg_id", (F.col("rev") != F.col("flipped")).alias("rev"), "flipped")


def reverse_walks(steps: DataFrame) -> DataFrame:
    """Walks that still hold a reverse step: they cannot be used."""
    return steps.filter("rev").select("walk_id").distinct()


def forward_edges(arcs: DataFrame) -> DataFrame:
    """(u, v) of arcs that leave a forward vertex; the target's strand is dropped."""
    return arcs.filter("v % 2 = 0").select(F.expr("v div 2").alias("u"), F.expr("w div 2").alias("v"))


def haplotypes_of(steps: DataFrame) -> DataFrame:
    """(seg_id, walks): walks through every segment, sorted."""
    return steps.groupBy("seg_id").agg(F.array_sort(F.collect_set("walk_id")).alias("walks"))


def walk_names(walks: DataFrame) -> DataFrame:
    return walks.select("walk_id", F.concat_ws(".", "sample", "hap").alias("name"))


def degrees(edges: DataFrame) -> DataFrame:
    """(v, n_in, n_out)."""
    both = edges.select(F.col("u").alias("v"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select("v", F.lit(1), F.lit(0)))
    return both.groupBy("v").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def presence(vertices: DataFrame, steps: DataFrame) -> DataFrame:
    """(seg_id, on_walk): whether any walk visits the segment."""
    seen = steps.select("seg_id").distinct().withColumn("_on", F.lit(True))
    return vertices.select("seg_id").join(seen, "seg_id", "left").select("seg_id", F.coalesce("_on", F.lit(False)).alias("on_walk"))


def isolated(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(seg_id) of vertices without any edge."""
    ends = edges.select(F.col("u").alias("seg_id")).union(edges.select("v"))
    return vertices.select("seg_id").join(ends, "seg_id", "left_anti")
