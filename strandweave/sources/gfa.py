"""GFA 1.1 text to typed tables, as DataFrame expressions over lines.

Lines that are no S, L or W record, shorter than three characters, or without a
tab in the second column are ignored. Malformed records go to ``rejects``; the
scan continues. Compression follows the file's extension.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MISSING = (1 << 31) - 1  # overlap given on one side only
TAG = r"^([A-Za-z][A-Za-z0-9]):([AifZHB]):(.*)$"


@dataclass
class GfaTables:
    """Raw records: ``line`` is the place in the file, names are not yet encoded."""

    segments: DataFrame  # line, name, seq, len, sn, so, sr, tags
    links: DataFrame  # line, from_name, from_rev, to_name, to_rev, ov, ow, rank, l1, l2, tags
    walks: DataFrame  # line, sample, hap, contig, st, en, steps, tags
    rejects: DataFrame  # line, value, reason


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) in file order."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), "value")


def tag_map(fields: Column) -> Column:
    """Typed tags of a record: name -> (type, value); the first of equal names wins."""
    ok = F.filter(fields, lambda x: x.rlike(TAG))
    pair = F.transform(
        ok,
        lambda x: F.struct(
            F.regexp_extract(x, TAG, 1).alias("key"),
            F.struct(F.regexp_extract(x, TAG, 2).alias("type"), F.regexp_extract(x, TAG, 3).alias("value")).alias("value"),
        ),
    )
    first = F.filter(pair, lambda p, i: ~F.exists(F.slice(pair, F.lit(1), i), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(first)


def tag(tags: Column, name: str, kind: str = "string") -> Column:
    return F.try_element_at(tags, F.lit(name))["value"].try_cast(kind)


def tag_delete(tags: Column, name: str) -> Column:
    return F.map_filter(tags, lambda k, _: k != name)


def tag_set(tags: Column, name: str, kind: str, value: Column) -> Column:
    new = F.map_from_arrays(F.array(F.lit(name)), F.array(F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value"))))
    return F.map_concat(tag_delete(tags, name), new)


def tag_numbers(tags: Column, name: str) -> Column:
    """Values of a ``B`` tag after its subtype letter."""
    return F.transform(F.slice(F.split(tag(tags, name), ","), 2, 1 << 30), lambda x: x.cast("double"))


def tag_text(tags: Column) -> Column:
    """Tags as they are written, by name."""
    parts = F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat_ws(":", e["key"], e["value"]["type"], e["value"]["value"]))
    return F.array_join(parts, "\t")


def overlap(field: Column) -> tuple[Column, Column]:
    """(ov, ow) of a link's overlap field.

    ``*``, an absent field and text of no known form give 0 and 0; ``:n`` leaves
    ov missing, ``a:b`` gives both; a CIGAR sums M, D, N and M, I, S.
    """
    f = F.coalesce(field, F.lit("*"))
    ops = F.regexp_extract_all(f, F.lit("([0-9]+[MIDNSHPX=])"), F.lit(1))

    def total(kinds: str) -> Column:
        hit = F.filter(ops, lambda x: F.lit(kinds).contains(F.right(x, F.lit(1))))
        return F.aggregate(hit, F.lit(0).cast("long"), lambda a, x: a + F.regexp_extract(x, "([0-9]+)", 1).cast("long"))

    def pick(cigar: Column, pair: Column, tail: Column) -> Column:
        return F.when(f.rlike(r"^([0-9]+[MIDNSHPX=])+$"), cigar).when(f.rlike(r"^[0-9]+:[0-9]+$"), pair).when(f.rlike(r"^:[0-9]+$"), tail).otherwise(F.lit(0).cast("long"))

    number = lambda g: F.regexp_extract(f, r"^([0-9]*):([0-9]+)$", g).try_cast("long")
    return pick(total("MDN"), number(1), F.lit(MISSING).cast("long")), pick(total("MIS"), number(2), number(2))


def walk_steps(walk: Column) -> Column:
    """Steps of ``>a<b`` text: array of (name, rev)."""
    raw = F.regexp_extract_all(walk, F.lit("([<>][^<>]+)"), F.lit(1))
    return F.transform(raw, lambda x: F.struct(F.substring(x, 2, 1 << 30).alias("name"), (F.left(x, F.lit(1)) == "<").alias("rev")))


def parse(lines: DataFrame) -> GfaTables:
    """Typed tables of (line, value) rows."""
    rows = lines.filter((F.length("value") >= 3) & (F.substring("value", 2, 1) == "\t")).withColumn("f", F.split(F.rtrim("value"), "\t"))
    rows = rows.withColumn("kind", F.col("f")[0]).filter(F.col("kind").isin("S", "L", "W"))
    get = lambda i: F.get(F.col("f"), F.lit(i))
    rest = lambda i: tag_map(F.slice(F.col("f"), i + 1, 1 << 30))
    sign = lambda i: get(i).isin("+", "-")
    reason = (
        F.when((F.col("kind") == "S") & (get(2).isNull()), "segment without sequence field")
        .when((F.col("kind") == "L") & ~F.coalesce(sign(2) & sign(4) & get(3).isNotNull(), F.lit(False)), "link orientation is neither + nor -")
        .when((F.col("kind") == "W") & (get(6).isNull() | get(2).try_cast("int").isNull()), "walk with too few fields")
    )
    rows = rows.withColumn("reason", reason)
    good = rows.filter("reason is null")
    seg = good.filter("kind = 'S'").select("line", get(1).alias("name"), F.when(get(2) != "*", get(2)).alias("seq"), rest(3).alias("tags"))
    ln = tag(F.col("tags"), "LN", "int")
    seg = seg.select(
        "line", "name", "seq",
        F.coalesce(F.length("seq"), ln, F.lit(0)).cast("int").alias("len"),
        tag(F.col("tags"), "SN").alias("sn"), tag(F.col("tags"), "SO", "int").alias("so"), tag(F.col("tags"), "SR", "int").alias("sr"),
        (F.col("seq").isNotNull() & (ln != F.length("seq"))).alias("length_differs"), "tags",
    )
    ov, ow = overlap(get(5))
    link = good.filter("kind = 'L'").select(
        "line", get(1).alias("from_name"), (get(2) == "-").alias("from_rev"), get(3).alias("to_name"), (get(4) == "-").alias("to_rev"),
        ov.cast("int").alias("ov"), ow.cast("int").alias("ow"), rest(6).alias("tags"),
    )
    link = link.withColumns({n: tag(F.col("tags"), t, "int") for n, t in (("rank", "SR"), ("l1", "L1"), ("l2", "L2"))})
    walk = good.filter("kind = 'W'").select(
        "line", get(1).alias("sample"), get(2).cast("int").alias("hap"), get(3).alias("contig"),
        get(4).try_cast("long").alias("st"), get(5).try_cast("long").alias("en"), walk_steps(get(6)).alias("steps"), rest(7).alias("tags"),
    )
    return GfaTables(seg, link, walk, rows.filter("reason is not null").select("line", "value", "reason"))


def read_gfa(spark: SparkSession, path: str) -> GfaTables:
    return parse(read_lines(spark, path))


def fasta_as_graph(records: DataFrame) -> DataFrame:
    """FASTA records (read_id, name, seq) as rank-0 segments s1, s2, ..."""
    return records.select(
        F.col("read_id").alias("line"), F.concat(F.lit("s"), F.col("read_id") + 1).alias("name"), "seq", F.length("seq").alias("len"),
        F.col("name").alias("sn"), F.lit(0).alias("so"), F.lit(0).alias("sr"), F.lit(False).alias("length_differs"),
        F.expr("map()").cast("map<string, struct<type: string, value: string>>").alias("tags"),
    )


def gfa_text(segments: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, at, value): S and L lines, ready to sort and write."""
    s = segments.select(F.lit(0).alias("kind"), F.col("line").alias("at"), F.concat_ws("\t", F.lit("S"), "name", F.coalesce("seq", F.lit("*")), F.concat(F.lit("LN:i:"), F.col("len")), F.concat(F.lit("SN:Z:"), F.col("sn")), F.concat(F.lit("SO:i:"), F.col("so")), F.concat(F.lit("SR:i:"), F.col("sr"))).alias("value"))
    strand = lambda c: F.when(F.col(c), "-").otherwise("+")
    ov = F.when(F.col("ov") == F.col("ow"), F.concat("ov", F.lit("M"))).otherwise(F.concat_ws(":", F.when(F.col("ov") != MISSING, F.col("ov").cast("string")).otherwise(""), F.col("ow").cast("string")))
    x = links.select(F.lit(1).alias("kind"), F.col("line").alias("at"), F.concat_ws("\t", F.lit("L"), "from_name", strand("from_rev"), "to_name", strand("to_rev"), ov, F.concat(F.lit("SR:i:"), F.col("rank")), F.concat(F.lit("L1:i:"), F.col("l1")), F.concat(F.lit("L2:i:"), F.col("l2"))).alias("value"))
    return s.union(x)


def write_gfa(segments: DataFrame, links: DataFrame, path: str) -> None:
    """Write S and L lines as text, segments first, in file order."""
    lines = gfa_text(segments, links)
    lines.repartitionByRange("kind", "at").sortWithinPartitions("kind", "at").select("value").write.mode("overwrite").text(path)
