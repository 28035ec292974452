"""Queries over reads: complements, k-mers, minimizers, spectrum, records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as seq
from ..operators import minimizers as mz
from ..operators.ids import dense_ids
from ..sources import fasta, gfa
from . import adapters as ad
from .book import Book

book = Book()
K, W = 31, 25

_MINIMIZERS = f"""WITH {ad.READS_SQL},
    k AS (SELECT read_id, seq, unnest(range(0, length(seq) - {K - 1})) AS p FROM reads WHERE length(seq) >= {K + W - 1}),
    c AS (SELECT read_id, p, least(substr(seq, p + 1, {K}), reverse(translate(substr(seq, p + 1, {K}), 'ACGT', 'TGCA'))) AS km FROM k),
    m AS (SELECT read_id, p, min(km) OVER (PARTITION BY read_id ORDER BY p ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW) AS key FROM c),
    d AS (SELECT read_id, p, key, lag(key) OVER (PARTITION BY read_id ORDER BY p) AS prev FROM m WHERE p >= {W - 1}),
    mins AS (SELECT read_id, p, key FROM d WHERE prev IS NULL OR prev <> key),
    spectrum AS (SELECT key, count(DISTINCT read_id) AS multiplicity FROM mins GROUP BY key)"""


def _sets(spark, sf_dir):
    return mz.extract_sets(ad.reads(spark, sf_dir), "read_id", "seq", K, W)


@book.query(f"WITH {ad.READS_SQL} SELECT read_id, length(seq) AS len, md5(reverse(translate(seq, 'ACGTacgt', 'TGCATGCA'))) AS rc_md5 FROM reads")
def revcomp_docs(spark, sf_dir):
    return ad.reads(spark, sf_dir).select("read_id", F.length("seq").cast("long").alias("len"), F.md5(seq.revcomp(F.col("seq"))).alias("rc_md5"))


@book.query(
    f"""SELECT doc_id, md5(reverse(translate(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'),
        '{seq.IUPAC}', '{seq.IUPAC_COMPLEMENT}'))) AS rc_md5 FROM documents"""
)
def iupac_complement(spark, sf_dir):
    d = ad.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(seq.revcomp_iupac(seq.upper_ascii(F.col("text")))).alias("rc_md5"))


@book.query(
    f"""WITH {ad.READS_SQL}, k AS (SELECT read_id, substr(seq, p + 1, 11) AS f FROM (SELECT read_id, seq, unnest(range(0, length(seq) - 10)) AS p FROM reads))
    SELECT read_id, count(*) AS n_kmers, count(DISTINCT least(f, reverse(translate(f, 'ACGT', 'TGCA')))) AS n_canonical FROM k GROUP BY read_id"""
)
def canonical_kmers(spark, sf_dir):
    return mz.kmer_counts(ad.reads(spark, sf_dir), "read_id", "seq", 11)


@book.query(_MINIMIZERS + " SELECT read_id, count(*) AS n, count(DISTINCT key) AS n_distinct, min(key) AS first_key FROM mins GROUP BY read_id")
def minimizers_docs(spark, sf_dir):
    found = mz.extract(ad.reads(spark, sf_dir), "read_id", "seq", K, W)
    return found.groupBy("read_id").agg(F.count("*").alias("n"), F.countDistinct("key").alias("n_distinct"), F.min("key").alias("first_key"))


@book.query(_MINIMIZERS + " SELECT key, multiplicity FROM spectrum")
def read_spectrum(spark, sf_dir):
    return mz.multiplicities(_sets(spark, sf_dir), K)


@book.query(_MINIMIZERS + " SELECT key, row_number() OVER (ORDER BY key) - 1 AS mid FROM spectrum")
def spectrum_ids(spark, sf_dir):
    """Dense ids in key order without a single-task window."""
    return dense_ids(mz.multiplicities(_sets(spark, sf_dir), K).select("key"), ["key"], "mid")


@book.query(_MINIMIZERS + " SELECT multiplicity, count(*) AS freq FROM spectrum GROUP BY multiplicity")
def multiplicity_hist(spark, sf_dir):
    return mz.histogram(mz.multiplicities(_sets(spark, sf_dir)))


@book.query(_MINIMIZERS + " SELECT max(multiplicity) AS max_multiplicity, max(freq) AS max_freq FROM (SELECT multiplicity, count(*) AS freq FROM spectrum GROUP BY 1)")
def hist_maxima(spark, sf_dir):
    return mz.histogram(mz.multiplicities(_sets(spark, sf_dir))).agg(F.max("multiplicity").alias("max_multiplicity"), F.max("freq").alias("max_freq"))


@book.query()
def murmur_spectrum(spark, sf_dir):
    """Spectrum with the folded 64-bit hash and its unsigned rank; no SQL has the hash."""
    from ..operators.anchors import minimizer_ids

    return minimizer_ids(mz.multiplicities(_sets(spark, sf_dir), K))


@book.query(
    f"""WITH {ad.READS_SQL}, n AS (SELECT read_id, seq, length(seq) AS len FROM reads WHERE length(seq) > 0)
    SELECT CAST(read_id AS VARCHAR) AS name, CAST(0 AS BIGINT) AS pos, '>' || read_id || ' LN:' || len AS value FROM n UNION ALL
    SELECT CAST(read_id AS VARCHAR), i + 1, substr(seq, i * 80 + 1, 80) FROM (SELECT *, unnest(range(0, (len + 79) // 80)) AS i FROM n)"""
)
def fasta_lines(spark, sf_dir):
    r = ad.reads(spark, sf_dir).filter(F.length("seq") > 0).select(F.col("read_id").cast("string").alias("name"), "seq")
    return fasta.fasta_lines(r, "seq").withColumn("pos", F.col("pos").cast("long"))


@book.query(
    """SELECT page_id, regexp_replace(regexp_replace(url, '^.*/', ''), '\\.[^.]*$', '') || '_' ||
        regexp_replace(regexp_replace(url || '.fq', '^.*/', ''), '\\.[^.]*$', '') AS name FROM pages"""
)
def hap_names(spark, sf_dir):
    p = ad.table(spark, sf_dir, "pages")
    return p.select("page_id", seq.haplotype_name(F.col("url"), F.concat("url", F.lit(".fq"))).alias("name"))


@book.query(
    """SELECT event_id, 'ev:Z:' || event_type || chr(9) || 'us:i:' || user_id AS tags, CAST(user_id AS INTEGER) AS us, user_id + 1 AS us_next FROM events"""
)
def tag_round_trip(spark, sf_dir):
    """Typed tags parsed, read, set, deleted and written again."""
    e = ad.table(spark, sf_dir, "events")
    raw = F.split(F.concat(F.lit("us:i:"), "user_id", F.lit("\tev:Z:"), "event_type", F.lit("\tbad\tus:i:9\txx:f:1.5")), "\t")
    t = e.select("event_id", "user_id", gfa.tag_map(raw).alias("t"))
    up = gfa.tag_set(F.col("t"), "us", "i", gfa.tag(F.col("t"), "us", "int") + 1)
    return t.select(
        "event_id", gfa.tag_text(gfa.tag_delete(F.col("t"), "xx")).alias("tags"), gfa.tag(F.col("t"), "us", "int").alias("us"), gfa.tag(up, "us", "long").alias("us_next")
    )


_GFA_LINES = """SELECT o_orderkey AS line, CASE o_orderkey % 4
        WHEN 0 THEN concat_ws(chr(9), 'S', CAST(o_custkey AS VARCHAR), '*', 'LN:i:' || (o_custkey % 50), 'SN:Z:' || o_orderpriority, 'SO:i:' || (o_custkey * 10), 'SR:i:0')
        WHEN 1 THEN concat_ws(chr(9), 'L', CAST(o_custkey AS VARCHAR), '+', CAST(o_custkey + 1 AS VARCHAR), CASE WHEN o_orderkey % 3 = 0 THEN '?' ELSE '-' END, '4M')
        WHEN 2 THEN concat_ws(chr(9), 'W', o_orderstatus, '1', 'c', '0', '9', '>' || o_custkey || '<' || (o_custkey + 1))
        ELSE concat_ws(chr(9), 'P', 'ignored') END AS value FROM orders"""


def _gfa_lines(spark, sf_dir):
    o = ad.table(spark, sf_dir, "orders").withColumn("c", F.col("o_custkey").cast("string"))
    kind = F.col("o_orderkey") % 4
    tab = F.lit("\t")
    return o.select(
        F.col("o_orderkey").alias("line"),
        F.when(kind == 0, F.concat(F.lit("S\t"), "c", F.lit("\t*\tLN:i:"), F.col("o_custkey") % 50, F.lit("\tSN:Z:"), "o_orderpriority", F.lit("\tSO:i:"), F.col("o_custkey") * 10, F.lit("\tSR:i:0")))
        .when(kind == 1, F.concat(F.lit("L\t"), "c", F.lit("\t+\t"), F.col("o_custkey") + 1, tab, F.when(F.col("o_orderkey") % 3 == 0, "?").otherwise("-"), F.lit("\t4M")))
        .when(kind == 2, F.concat(F.lit("W\t"), "o_orderstatus", F.lit("\t1\tc\t0\t9\t>"), "c", F.lit("<"), F.col("o_custkey") + 1))
        .otherwise(F.lit("P\tignored")).alias("value"),
    )


@book.query(f"WITH l AS ({_GFA_LINES}) SELECT line, value FROM l WHERE left(value, 1) = 'S' OR (left(value, 1) = 'L' AND line % 3 <> 0)")
def gfa_written(spark, sf_dir):
    """S and L lines parsed and written again."""
    t = gfa.parse(_gfa_lines(spark, sf_dir))
    return gfa.gfa_text(t.segments, t.links).select(F.col("at").alias("line"), "value")


@book.query(f"WITH {ad.READS_SQL} SELECT CAST(read_id AS VARCHAR) AS name, length(seq) AS len, md5(seq) AS seq_md5 FROM reads WHERE length(seq) > 0")
def fasta_round_trip(spark, sf_dir):
    """Reads written as FASTA and read again by record, so that files split."""
    from ..operators.lineage import scratch

    path = scratch(spark, "reads") + ".fa"
    r = ad.reads(spark, sf_dir).filter(F.length("seq") > 0).select(F.col("read_id").cast("string").alias("name"), "seq")
    fasta.write_fasta(r, path)
    return fasta.read_fasta(spark, path).select("name", F.length("seq").cast("long").alias("len"), F.md5("seq").alias("seq_md5"))


@book.query(
    f"""WITH l AS ({_GFA_LINES}) SELECT line, left(value, 1) AS kind,
        CASE WHEN left(value, 1) = 'L' AND line % 3 = 0 THEN 'reject' WHEN left(value, 1) = 'S' THEN 'len ' || regexp_extract(value, 'LN:i:([0-9]+)', 1)
        WHEN left(value, 1) = 'L' THEN 'ov 4 4' ELSE 'steps ' || replace(replace(split_part(value, chr(9), 7), '>', '+'), '<', '-') END AS found
    FROM l WHERE left(value, 1) IN ('S', 'L', 'W')"""
)
def gfa_records(spark, sf_dir):
    """S, L, W and rejected lines of generated GFA text."""
    t = gfa.parse(_gfa_lines(spark, sf_dir))
    steps = F.array_join(F.transform("steps", lambda x: F.concat(F.when(x["rev"], "-").otherwise("+"), x["name"])), "")
    return (
        t.segments.select("line", F.lit("S").alias("kind"), F.concat(F.lit("len "), "len").alias("found"))
        .union(t.links.select("line", F.lit("L"), F.concat_ws(" ", F.lit("ov"), "ov", "ow")))
        .union(t.walks.select("line", F.lit("W"), F.concat(F.lit("steps "), steps)))
        .union(t.rejects.select("line", F.left("value", F.lit(1)), F.lit("reject")))
    )


@book.query(
    """WITH s AS (SELECT c_custkey AS seg_id, c_mktsegment AS sn, c_nationkey * 100 AS so, c_custkey % 90 AS len, c_nationkey % 3 AS sr FROM customer)
    SELECT sn, CAST(min(so) AS BIGINT) AS min_so, CAST(max(so + len) AS BIGINT) AS max_so, CAST(arg_min(sr, seg_id) AS BIGINT) AS rank FROM s GROUP BY sn"""
)
def stable_sequences(spark, sf_dir):
    from ..operators.graph import stable_sequences as rollup

    c = ad.table(spark, sf_dir, "customer")
    s = c.select(F.col("c_custkey").alias("seg_id"), F.col("c_mktsegment").alias("sn"), (F.col("c_nationkey") * 100).cast("long").alias("so"), (F.col("c_custkey") % 90).alias("len"), (F.col("c_nationkey") % 3).cast("long").alias("sr"))
    return rollup(s)
