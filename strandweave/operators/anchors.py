"""Anchors: haplotype minimizers that reads hold too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def offsets(steps: DataFrame, segments: DataFrame) -> DataFrame:
    """(walk_id, pos, seg_id, start, end): where each step lies on its haplotype."""
    w = Window.partitionBy("walk_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    s = steps.join(segments.select("seg_id", "len"), "seg_id").withColumn("end", F.sum("len").over(w))
    return s.select("walk_id", "pos", "seg_id", (F.col("end") - F.col("len")).alias("start"), "end")


def haplotype_sequences(steps: DataFrame, segments: DataFrame) -> DataFrame:
    """(walk_id, seq)."""
    from ..functions.sequence import joined

    return steps.join(segments.select("seg_id", "seq"), "seg_id").groupBy("walk_id").agg(joined(F.col("pos"), F.col("seq")).alias("seq"))


def haplotype_lengths(steps: DataFrame, segments: DataFrame) -> DataFrame:
    return steps.join(segments.select("seg_id", "len"), "seg_id").groupBy("walk_id").agg(F.sum("len").alias("len"))


def with_vertices(found: DataFrame, places: DataFrame, columns: DataFrame, k: int) -> DataFrame:
    """(walk_id, at, key, vtxs): distinct vertices under each minimizer, by rank.

    Interval overlap within a walk. Steps and minimizers are both dealt to tiles
    of the haplotype, so the join is an equi-join whose groups stay small.
    """
    tile = 1024
    steps = places.filter("end > start").select("walk_id", "seg_id", "start", "end", F.explode(F.sequence(F.expr(f"start div {tile}"), F.expr(f"(end - 1) div {tile}"))).alias("tile"))
    mins = found.select("walk_id", F.col("pos").alias("at"), "key").withColumn("stop", F.col("at") + k)
    mins = mins.withColumn("tile", F.explode(F.sequence(F.expr(f"at div {tile}"), F.expr(f"(stop - 1) div {tile}"))))
    hits = mins.join(steps, ["walk_id", "tile"]).filter("start < stop and end > at")
    hits = hits.join(columns.select("seg_id", "rank"), "seg_id")
    return hits.groupBy("walk_id", "at", "key").agg(F.transform(F.array_sort(F.collect_set(F.struct("rank", "seg_id"))), lambda x: x["seg_id"]).alias("vtxs"))


def match(hap_minimizers: DataFrame, spectrum: DataFrame) -> DataFrame:
    """Equi-join on the key; the optimizer picks the strategy."""
    return hap_minimizers.join(spectrum.select("key", "multiplicity"), "key")


def drop_ubiquitous(anchors: DataFrame, walks: int, threshold: float = 1.0) -> DataFrame:
    """Drop every key with a vertex path in ``threshold * walks`` occurrences or more.

    Occurrences count, not haplotypes: a path twice in one walk counts twice.
    """
    worst = anchors.groupBy("key", "vtxs").agg(F.count("*").alias("n")).groupBy("key").agg(F.max("n").alias("n"))
    return anchors.join(worst.filter(F.col("n") < threshold * walks).select("key"), "key", "left_semi")


def counts(found: DataFrame, anchors: DataFrame, kept: DataFrame) -> DataFrame:
    """Per walk: minimizers, matched, filtered and retained anchors."""
    tag = lambda d, n: d.select("walk_id", *[F.lit(int(n == x)).alias(x) for x in ("minimizers", "matched", "retained")])
    rows = tag(found, "minimizers").union(tag(anchors, "matched")).union(tag(kept, "retained"))
    out = rows.groupBy("walk_id").agg(*[F.sum(x).alias(x) for x in ("minimizers", "matched", "retained")])
    return out.withColumn("filtered", F.col("matched") - F.col("retained"))


def minimizer_ids(spectrum: DataFrame) -> DataFrame:
    """``mid``: rank of each key's folded murmur hash in unsigned order."""
    from ..functions.sequence import murmur, unsigned_order
    from .ids import dense_ids

    hashed = spectrum.withColumn("hash", murmur(F.col("key"))).withColumn("_u", unsigned_order(F.col("hash")))
    return dense_ids(hashed, ["_u"], "mid").drop("_u")
