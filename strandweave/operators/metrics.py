"""Accuracy metrics of inferred haplotypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sv_count(variants: DataFrame, least: int = 50) -> DataFrame:
    """Alternatives that change the length by ``least`` or more; variants are (chrom, ref, alts)."""
    alt = variants.select("chrom", "ref", F.explode("alts").alias("alt"))
    return alt.groupBy("chrom").agg(F.sum(F.when(F.abs(F.length("alt") - F.length("ref")) >= least, 1).otherwise(0)).cast("long").alias("n_sv"))


def assembly_length(seqs: DataFrame) -> DataFrame:
    """(sample, mb): lengths of a sample's sequences in Mb, joined by a bar."""
    one = seqs.select("sample", "name", F.round(F.length("seq") / 1e6, 2).alias("mb"))
    return one.groupBy("sample").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "mb"))), lambda x: F.format_string("%.2f", x["mb"])), "|").alias("mb"))


def switch_errors(calls: DataFrame, by: list[str], order: list[str], same: Column) -> DataFrame:
    """Switch error rate: changes of phase agreement between neighbouring sites."""
    w = Window.partitionBy(*by).orderBy(*order)
    flips = calls.withColumn("_s", same.cast("int")).withColumn("_p", F.lag("_s").over(w))
    out = flips.groupBy(*by).agg(F.count("_p").alias("pairs"), F.sum(F.when(F.col("_s") != F.col("_p"), 1).otherwise(0)).cast("long").alias("switches"))
    return out.withColumn("rate", F.when(F.col("pairs") > 0, F.col("switches") / F.col("pairs")))


def precision_recall(truth: DataFrame, called: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of called against truth, by exact key."""
    t = truth.select(*by, *key).distinct().withColumn("_t", F.lit(1))
    c = called.select(*by, *key).distinct().withColumn("_c", F.lit(1))
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    both = t.join(c, [*by, *key], "full").groupBy(*by).agg(
        n(F.col("_t").isNotNull() & F.col("_c").isNotNull()).alias("tp"), n(F.col("_t").isNull()).alias("fp"), n(F.col("_c").isNull()).alias("fn")
    )
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp")))
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn")))
    return both.withColumns({"precision": p, "recall": r, "f1": F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))})


def matched_by_size(truth: DataFrame, called: DataFrame, by: list[str], distance: int = 500, similarity: float = 0.7) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of variants (by, pos, size), matched with tolerance.

    A variant is matched if the other set has one at most ``distance`` away whose size
    is ``similarity`` of its own or the other way round. Positions are dealt to
    tiles of that distance, so the join is on (by, tile).
    """
    def sided(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*by, F.col("pos").alias(f"{tag}_pos"), F.abs("size").alias(f"{tag}_size")).distinct()

    t, c = sided(truth, "t"), sided(called, "c")
    tile = lambda n: F.floor(F.col(n) / distance)
    near = F.explode(F.sequence(tile("c_pos") - 1, tile("c_pos") + 1))
    pairs = t.withColumn("_tile", tile("t_pos")).join(c.withColumn("_tile", near), [*by, "_tile"])
    close = (F.abs(F.col("t_pos") - F.col("c_pos")) <= distance) & (F.least("t_size", "c_size") >= similarity * F.greatest("t_size", "c_size"))
    pairs = pairs.filter(close)
    n = lambda df, name: df.groupBy(*by).agg(F.count("*").alias(name))
    hit_t, hit_c = pairs.select(*by, "t_pos", "t_size").distinct(), pairs.select(*by, "c_pos", "c_size").distinct()
    out = n(t, "n_t").join(n(c, "n_c"), by, "full").join(n(hit_t, "tp"), by, "left").join(n(hit_c, "tp_called"), by, "left").na.fill(0)
    out = out.select(*by, "tp", (F.col("n_c") - F.col("tp_called")).alias("fp"), (F.col("n_t") - F.col("tp")).alias("fn"), "tp_called", "n_t", "n_c")
    p = F.when(F.col("n_c") > 0, F.col("tp_called") / F.col("n_c"))
    r = F.when(F.col("n_t") > 0, F.col("tp") / F.col("n_t"))
    return out.withColumns({"precision": p, "recall": r}).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))).drop("tp_called", "n_t", "n_c")


def gaps_and_islands(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Run-length report: (by, value, first, last) of equal neighbours."""
    w = Window.partitionBy(*by).orderBy(order)
    new = rows.withColumn("_n", F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    runs = new.withColumn("_run", F.sum("_n").over(w))
    return runs.groupBy(*by, "_run", value).agg(F.min(order).alias("first"), F.max(order).alias("last")).drop("_run")
