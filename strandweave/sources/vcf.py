"""Phased VCF and a reference sequence to graph tables.

Every variant splits the reference; alternatives become bubbles; every phased
allele column becomes a walk ``sample.hap``. Overlapping variants are refused.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, id, ref, alts, qual, filter, info, samples, genotypes)."""
    lines = spark.read.text(path)
    head = lines.filter(F.col("value").startswith("#CHROM")).first()
    names = head["value"].split("\t")[9:] if head else []
    f = F.split("value", "\t")
    gt = F.transform(F.slice(f, 10, 1 << 30), lambda x: F.split(x, ":")[0])
    return lines.filter(~F.col("value").startswith("#") & (F.length("value") > 0)).select(
        f[0].alias("chrom"), f[1].cast("long").alias("pos"), f[2].alias("id"), f[3].alias("ref"), F.split(f[4], ",").alias("alts"),
        f[5].alias("qual"), f[6].alias("filter"), f[7].alias("info"), F.array(*map(F.lit, names)).cast("array<string>").alias("samples"), gt.alias("genotypes"),
    )


def split_alts(vcf: DataFrame) -> DataFrame:
    """One row for each alternative."""
    return vcf.select("*", F.posexplode("alts").alias("alt_no", "alt")).drop("alts")


def slices(cuts: DataFrame, reference: DataFrame) -> DataFrame:
    """(chrom, no, prev, seq): the reference from ``prev`` up to ``pos``, or to its end if pos is null.

    A chromosome's sequence goes once to the task that cuts it, never into rows of variants.
    """

    def run(part: pa.Table, whole: pa.Table) -> pa.Table:
        texts = whole.column("seq").to_pylist()
        rows = zip(part.column("prev").to_pylist(), part.column("pos").to_pylist(), strict=True)
        seq = [texts[0][prev - 1 : None if pos is None else pos - 1] if texts else None for prev, pos in rows]
        keep = part.select(["chrom", "no", "prev"]).append_column("seq", pa.array(seq, pa.string()))
        return keep.filter(keep.column("seq").is_valid())

    whole = reference.select(F.col("name").alias("chrom"), "seq")
    cuts = cuts.select("chrom", F.col("no").cast("int").alias("no"), F.col("prev").cast("long").alias("prev"), F.col("pos").cast("long").alias("pos"))
    return cuts.groupBy("chrom").cogroup(whole.groupBy("chrom")).applyInArrow(run, "chrom string, no int, prev long, seq string")


def build_graph(vcf: DataFrame, reference: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segments, links, walks) with names; ``reference`` has (name, seq).

    Segments: ``<chrom>:<pos>`` for reference slices (allele 0 at a variant) and
    ``<chrom>:<pos>:<n>`` for alternative n. Empty slices are left out.
    """
    w = Window.partitionBy("chrom").orderBy("pos")
    v = vcf.withColumn("end", F.col("pos") + F.length("ref")).withColumn("prev", F.coalesce(F.lag("end").over(w), F.lit(1).cast("long"))).withColumn("no", F.row_number().over(w))
    good = F.when(F.col("pos") < F.col("prev"), F.raise_error(F.lit("variants overlap"))).otherwise(F.col("pos"))
    checked = v.select("chrom", good.alias("pos"), "no", "prev", "samples", "genotypes", F.concat(F.array("ref"), "alts").alias("alleles"))
    tail = v.groupBy("chrom").agg((F.max("no") + 1).alias("no"), F.max("end").alias("prev"))
    backbone = slices(checked.select("chrom", "no", "prev", "pos").union(tail.select("chrom", "no", "prev", F.lit(None).cast("long"))), reference)
    backbone = backbone.select("chrom", (F.col("no") * 2).alias("col"), F.concat_ws(":", "chrom", "prev").alias("name"), "seq")
    name = lambda allele: F.concat_ws(":", F.col("chrom"), F.col("pos").cast("string"), F.when(allele > 0, allele).cast("string"))
    allele = checked.select("chrom", (F.col("no") * 2 + 1).alias("col"), "pos", F.posexplode("alleles").alias("a", "seq")).select("chrom", "col", name(F.col("a")).alias("name"), "seq")
    segments = backbone.union(allele).filter(F.length("seq") > 0)
    hap = checked.select("chrom", "no", "pos", F.explode(F.arrays_zip("samples", "genotypes")).alias("g")).select("chrom", "no", "pos", F.col("g.samples").alias("sample"), F.posexplode(F.split("g.genotypes", r"[|/]")).alias("hap", "gt"))
    chosen = hap.select("chrom", (F.col("no") * 2 + 1).alias("col"), "sample", "hap", name(F.coalesce(F.col("gt").try_cast("int"), F.lit(0))).alias("name"))
    lanes = hap.select("chrom", "sample", "hap").distinct()
    steps = chosen.union(lanes.join(backbone, "chrom").select("chrom", "col", "sample", "hap", "name"))
    steps = steps.join(segments.select("chrom", "name"), ["chrom", "name"], "left_semi")
    walks = steps.groupBy("sample", "hap", F.col("chrom").alias("contig")).agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "name"))), lambda x: F.struct(x["name"].alias("name"), F.lit(False).alias("rev"))).alias("steps"))
    nxt = steps.withColumn("to_name", F.lead("name").over(Window.partitionBy("chrom", "sample", "hap").orderBy("col")))
    links = nxt.filter("to_name is not null").select(F.col("name").alias("from_name"), "to_name").distinct()
    return segments, links, walks
