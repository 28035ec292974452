"""The driver's tables as reads, links and walks, as frames and as DuckDB views.

- reads: the letters of every document, mapped to ACGT.
- steps: one step for each user and day, the day's first event; a vertex is a
  day and an event type, so walks run forward in time.
- link records: every order is a link between two of 200 segments, with an
  overlap field in one of the grammar's forms.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import gfa

BASES = "ACGTACGTACGTACGTACGTACGTAC"
SEGMENTS = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.sequence import upper_ascii

    letters = upper_ascii(F.regexp_replace("text", "[^A-Za-z]", ""))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_id"), F.translate(letters, string.ascii_uppercase, BASES).alias("seq"))


READS_SQL = f"""reads AS (SELECT doc_id AS read_id,
    translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{string.ascii_uppercase}', '{BASES}') AS seq FROM documents)"""


def named_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(walk_id, pos, day, kind, name)."""
    e = table(spark, sf_dir, "events").withColumn("day", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")))
    s = e.groupBy(F.col("user_id").alias("walk_id"), "day").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("kind"))
    w = Window.partitionBy("walk_id").orderBy("day")
    return s.select("walk_id", (F.row_number().over(w) - 1).alias("pos"), "day", "kind", F.concat_ws(":", F.col("day").cast("string"), "kind").alias("name"))


def segments(named: DataFrame) -> DataFrame:
    """(seg_id, name, seq, len, day), ids by (day, kind)."""
    from ..operators.ids import dense_ids

    v = dense_ids(named.select("day", "kind", "name").distinct(), ["day", "kind"], "seg_id")
    seq = F.translate(F.md5("name"), "0123456789abcdef", "ACGT" * 4)
    return v.select("seg_id", "name", seq.alias("seq"), F.length(seq).alias("len"), "day")


def steps(named: DataFrame, segs: DataFrame) -> DataFrame:
    """(walk_id, pos, seg_id)."""
    return named.join(segs.select("name", "seg_id"), "name").select("walk_id", "pos", "seg_id")


STEPS_SQL = """named AS (SELECT user_id AS walk_id, day, arg_min(event_type, row(ts, event_id)) AS kind
        FROM (SELECT *, CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS INTEGER) AS day FROM events) GROUP BY 1, 2),
    segs AS (SELECT row_number() OVER (ORDER BY day, kind) - 1 AS seg_id, day, kind, day || ':' || kind AS name,
        translate(md5(day || ':' || kind), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq, 32 AS len FROM (SELECT DISTINCT day, kind FROM named)),
    steps AS (SELECT walk_id, row_number() OVER (PARTITION BY walk_id ORDER BY day) - 1 AS pos, seg_id FROM named JOIN segs USING (day, kind)),
    leads AS (SELECT *, lead(seg_id) OVER (PARTITION BY walk_id ORDER BY pos) AS nxt FROM steps),
    edges AS (SELECT DISTINCT seg_id AS u, nxt AS v FROM leads WHERE nxt IS NOT NULL)"""


def link_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line, from_name, from_rev, to_name, to_rev, ov, ow, rank, field)."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    forms = F.array(*map(F.lit, ("*", ":7", "5M", "3M2I1D4M", "12:9", "bad", "2S3N")))
    field = F.get(forms, (key % 7).cast("int"))
    ov, ow = gfa.overlap(field)
    return o.select(
        key.alias("line"), (F.col("o_custkey") % SEGMENTS).cast("string").alias("from_name"), (key % 3 == 0).alias("from_rev"),
        (F.floor(key / 4) * 7 % SEGMENTS).cast("string").alias("to_name"), (key % 5 == 0).alias("to_rev"),
        ov.cast("long").alias("ov"), ow.cast("long").alias("ow"), (key % 4).cast("int").alias("rank"), field.alias("field"),
    )


def link_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seg_id, name, len): length 0 where a segment is undefined."""
    s = table(spark, sf_dir, "customer").select((F.col("c_custkey") % SEGMENTS).alias("seg_id")).distinct()
    return s.select("seg_id", F.col("seg_id").cast("string").alias("name"), F.when(F.col("seg_id") % 17 == 0, 0).otherwise(5 + F.col("seg_id") % 23).cast("int").alias("len"))


def arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(v, w, ov, ow, rank, link_id, comp)."""
    n = lambda c: F.col(c).cast("long") * 2
    return link_records(spark, sf_dir).select(
        (n("from_name") + F.col("from_rev").cast("long")).alias("v"), (n("to_name") + F.col("to_rev").cast("long")).alias("w"),
        "ov", "ow", "rank", F.col("line").alias("link_id"), F.lit(False).alias("comp"),
    )


LINKS_SQL = f"""lsegs AS (SELECT seg_id, CASE WHEN seg_id % 17 = 0 THEN 0 ELSE 5 + seg_id % 23 END AS len
        FROM (SELECT DISTINCT c_custkey % {SEGMENTS} AS seg_id FROM customer)),
    lrec AS (SELECT o_orderkey AS line, o_custkey % {SEGMENTS} AS a, o_orderkey % 3 = 0 AS ar,
        (o_orderkey // 4) * 7 % {SEGMENTS} AS b, o_orderkey % 5 = 0 AS br, o_orderkey % 4 AS rank,
        (['*', ':7', '5M', '3M2I1D4M', '12:9', 'bad', '2S3N'])[o_orderkey % 7 + 1] AS field FROM orders),
    ovl AS (SELECT *, CASE WHEN regexp_full_match(field, '([0-9]+[MIDNSHPX=])+')
            THEN CAST(coalesce(list_sum([CAST(x AS BIGINT) FOR x IN regexp_extract_all(field, '([0-9]+)[MDN]', 1)]), 0) AS BIGINT)
            WHEN regexp_full_match(field, '[0-9]+:[0-9]+') THEN CAST(split_part(field, ':', 1) AS BIGINT)
            WHEN regexp_full_match(field, ':[0-9]+') THEN 2147483647 ELSE 0 END AS ov,
        CASE WHEN regexp_full_match(field, '([0-9]+[MIDNSHPX=])+')
            THEN CAST(coalesce(list_sum([CAST(x AS BIGINT) FOR x IN regexp_extract_all(field, '([0-9]+)[MIS]', 1)]), 0) AS BIGINT)
            WHEN regexp_full_match(field, '[0-9]*:[0-9]+') THEN CAST(split_part(field, ':', 2) AS BIGINT) ELSE 0 END AS ow FROM lrec),
    arcs AS (SELECT a * 2 + ar::INT AS v, b * 2 + br::INT AS w, ov, ow, rank, line AS link_id, FALSE AS comp FROM ovl)"""
