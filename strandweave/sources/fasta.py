"""FASTA and FASTQ records, and the FASTA sink.

A name ends at the first white space, the comment is dropped, sequence lines are
joined. A FASTQ record whose quality is not as long as its sequence stops the
scan of its file. ``read_fasta`` reads plain FASTA by record, so that a file of any size
is split; FASTQ and mixed files are one unit of work each (``read_records``), and many
of them are read in parallel. Compression follows the extension (.gz).
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import wrap


def records(lines: list[str]) -> Iterator[tuple[str, str]]:
    """(name, sequence) of FASTA or FASTQ lines, mixed if need be."""
    i, n = 0, len(lines)
    while i < n and lines[i][:1] not in (">", "@"):
        i += 1
    while i < n:
        head = lines[i][1:].split(None, 1)
        name = head[0] if head and not lines[i][1:2].isspace() else ""
        i += 1
        seq: list[str] = []
        while i < n and lines[i][:1] not in (">", "@", "+"):
            seq.append("".join(lines[i].split()))
            i += 1
        text = "".join(seq)
        if i < n and lines[i].startswith("+"):
            i += 1
            have = 0
            while i < n and have < len(text):
                have += len(lines[i])
                i += 1
            if have != len(text):
                return
            while i < n and lines[i][:1] not in (">", "@"):
                i += 1
        yield name, text


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, rec, name, seq); ``rec`` counts from 0 in each file."""

    def run(batches):
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                found = list(records(raw.decode("latin-1").splitlines()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(found), pa.string()), pa.array(range(len(found)), pa.int64()), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())],
                    ["file", "rec", "name", "seq"],
                )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, rec long, name string, seq string")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, name, seq) of FASTA files; ids grow with the place in a file."""
    rows = spark.read.text(path, lineSep="\n>").withColumn("value", F.regexp_replace("value", "^>", ""))
    first = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    seq = F.regexp_replace(F.expr("substring(value, length(regexp_extract(value, '^([^\\\\r\\\\n]*)', 1)) + 1)"), r"\s", "")
    return rows.select(F.monotonically_increasing_id().alias("read_id"), F.regexp_extract(first, r"^(\S*)", 1).alias("name"), seq.alias("seq"))


def reads(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, name, seq) of one file; FASTA by its extension is read in splits."""
    if re.search(r"\.(fa|fasta|fna)(\.gz)?$", path):
        return read_fasta(spark, path)
    return read_records(spark, path).select(F.col("rec").alias("read_id"), "name", "seq")


def fasta_lines(rows: DataFrame, label: str, prefix: str = "LN") -> DataFrame:
    """(name, pos, value): header and 80-column lines of (name, seq) rows."""
    head = F.concat(F.lit(">"), F.col("name"), F.lit(f" {prefix}:"), F.length(label))
    return rows.select("name", F.posexplode(F.concat(F.array(head), wrap(F.col(label)))).alias("pos", "value"))


def write_fasta(rows: DataFrame, path: str, prefix: str = "LN") -> None:
    """Write (name, seq) rows as one FASTA part for each name, in line order.

    ``prefix`` is LN for one haplotype and bp for two.
    """
    lines = fasta_lines(rows, "seq", prefix).repartition("name").sortWithinPartitions("name", "pos")
    lines.select("value").write.mode("overwrite").text(path)


def write_haplotypes(rows: DataFrame, path: str) -> None:
    """Write (name, seq) rows as FASTA, a folder ``hap=<name>`` for each haplotype."""
    lines = fasta_lines(rows, "seq").withColumn("hap", F.col("name")).repartition("hap").sortWithinPartitions("hap", "pos")
    lines.select("hap", "value").write.mode("overwrite").partitionBy("hap").text(path)
