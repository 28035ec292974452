"""Queries over links, walks and columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anchors as anc
from ..operators import frames, graph, ordering
from ..operators import minimizers as mz
from . import adapters as ad
from .book import Book

book = Book()
HK, HW = 15, 5

_OK = "ok AS (SELECT * FROM arcs WHERE v // 2 IN (SELECT seg_id FROM lsegs WHERE len > 0) AND w // 2 IN (SELECT seg_id FROM lsegs WHERE len > 0))"
_FILLED = f"""{_OK}, back AS (SELECT xor(w, 1) AS v, xor(v, 1) AS w, count(*) AS n, any_value(ow) AS bov, any_value(ov) AS bow FROM ok GROUP BY 1, 2),
    fills AS (SELECT a.v, a.w, CASE WHEN ov = 2147483647 THEN bov ELSE ov END AS ov, CASE WHEN ow = 2147483647 THEN bow ELSE ow END AS ow, rank, link_id, comp
        FROM ok a LEFT JOIN back b ON a.v = b.v AND a.w = b.w WHERE (ov <> 2147483647 AND ow <> 2147483647) OR n = 1),
    filled AS (SELECT * FROM fills WHERE ov <> 2147483647 AND ow <> 2147483647)"""
_FULL = f"""{_FILLED}, turned AS (SELECT xor(w, 1) AS v, xor(v, 1) AS w, ow AS ov, ov AS ow, rank, link_id, TRUE AS comp FROM filled),
    whole AS (SELECT * FROM filled UNION ALL SELECT * FROM turned t WHERE NOT EXISTS (SELECT 1 FROM filled f WHERE f.v = t.v AND f.w = t.w)),
    norm AS (SELECT v, w, least(ov, a.len) AS ov, least(ow, b.len) AS ow, a.len - least(ov, a.len) AS lv, rank, link_id, comp
        FROM whole JOIN lsegs a ON v // 2 = a.seg_id JOIN lsegs b ON w // 2 = b.seg_id)"""


def _arcs(spark, sf_dir):
    return ad.arcs(spark, sf_dir), ad.link_segments(spark, sf_dir)


def _defined(spark, sf_dir):
    arcs, segs = _arcs(spark, sf_dir)
    ok = graph.defined(segs).select("seg_id")
    return arcs.join(ok, F.expr("v div 2") == ok.seg_id, "left_semi").join(ok, F.expr("w div 2") == ok.seg_id, "left_semi"), segs


@book.query(f"WITH {ad.LINKS_SQL} SELECT line, field, ov, ow FROM ovl")
def cigar_overlap(spark, sf_dir):
    return ad.link_records(spark, sf_dir).select("line", "field", "ov", "ow")


@book.query(
    f"""WITH {ad.LINKS_SQL}, seen AS (SELECT a AS name, min(line * 3 + 1) AS place FROM lrec GROUP BY 1 UNION ALL SELECT b, min(line * 3 + 2) FROM lrec GROUP BY 1)
    SELECT CAST(name AS VARCHAR) AS name, row_number() OVER (ORDER BY place) - 1 AS seg_id FROM (SELECT name, min(place) AS place FROM seen GROUP BY name)"""
)
def segment_dict(spark, sf_dir):
    links = ad.link_records(spark, sf_dir)
    none = links.limit(0).select(F.col("from_name").alias("name"), "line")
    return graph.segment_ids(none, links).select("name", "seg_id")


@book.query(f"WITH {ad.LINKS_SQL} SELECT seg_id FROM lsegs WHERE len = 0")
def undefined_segments(spark, sf_dir):
    return graph.undefined(ad.link_segments(spark, sf_dir)).select("seg_id")


@book.query(f"WITH {ad.LINKS_SQL}, {_FILLED} SELECT v, w, ov, ow, link_id FROM filled")
def fill_overlaps(spark, sf_dir):
    arcs, _ = _defined(spark, sf_dir)
    return graph.fill_overlaps(arcs).select("v", "w", "ov", "ow", "link_id")


@book.query(f"WITH {ad.LINKS_SQL}, {_FULL} SELECT v, w, ov, ow, link_id, comp FROM whole")
def complement_arcs(spark, sf_dir):
    arcs, _ = _defined(spark, sf_dir)
    return graph.add_complements(graph.fill_overlaps(arcs)).select("v", "w", "ov", "ow", "link_id", "comp")


@book.query(f"WITH {ad.LINKS_SQL}, {_FULL} SELECT v, w, ov, ow, lv, link_id, comp FROM norm")
def normalised_arcs(spark, sf_dir):
    return graph.normalise(*_arcs(spark, sf_dir)).select("v", "w", "ov", "ow", "lv", "link_id", "comp")


@book.query(f"WITH {ad.LINKS_SQL}, {_FULL} SELECT v, w, lv, link_id, comp FROM norm ORDER BY v, lv")
def sorted_arcs(spark, sf_dir):
    arcs, segs = _arcs(spark, sf_dir)
    return graph.sort_arcs(graph.normalise(arcs, segs), segs).select("v", "w", "lv", "link_id", "comp")


@book.query(f"WITH {ad.LINKS_SQL} SELECT v, w, count(*) AS n FROM arcs GROUP BY 1, 2 HAVING count(*) > 1")
def multi_edges(spark, sf_dir):
    return graph.multi_edges(ad.arcs(spark, sf_dir))


@book.query(f"WITH {ad.LINKS_SQL} SELECT v, w, rank, link_id FROM (SELECT *, row_number() OVER (PARTITION BY v, w ORDER BY rank, link_id) AS r FROM arcs) WHERE r = 1")
def single_edges(spark, sf_dir):
    return graph.single_edges(ad.arcs(spark, sf_dir)).select("v", "w", F.col("rank").cast("long").alias("rank"), "link_id")


@book.query(
    f"""WITH {ad.LINKS_SQL}, hits AS (SELECT v, w, count(*) AS n, any_value(link_id) AS l FROM arcs GROUP BY 1, 2), q AS (SELECT DISTINCT w AS v, v AS w FROM arcs)
    SELECT q.v, q.w, CASE WHEN n IS NULL THEN -1 WHEN n > 1 THEN -2 ELSE l END AS link FROM q LEFT JOIN hits USING (v, w)"""
)
def find_arcs(spark, sf_dir):
    arcs = ad.arcs(spark, sf_dir)
    return graph.find_arc(arcs, arcs.select(F.col("w").alias("v"), F.col("v").alias("w")).distinct())


@book.query(
    f"""WITH {ad.LINKS_SQL} SELECT v, w, link_id FROM arcs WHERE (v // 2) % 11 <> 0 AND (w // 2) % 11 <> 0"""
)
def deleted_segments(spark, sf_dir):
    arcs, segs = _arcs(spark, sf_dir)
    gone = ad.table(spark, sf_dir, "customer").select((F.col("c_custkey") % ad.SEGMENTS).alias("seg_id")).filter("seg_id % 11 = 0").distinct()
    gone = gone.union(spark.range(ad.SEGMENTS).filter("id % 11 = 0").toDF("seg_id")).distinct()
    return graph.delete_segments(segs, arcs, gone)[1].select("v", "w", "link_id")


@book.query(f"WITH {ad.LINKS_SQL}, {_FULL} SELECT v // 2 AS u, w // 2 AS v FROM norm WHERE v % 2 = 0")
def forward_edges(spark, sf_dir):
    return graph.forward_edges(graph.normalise(*_arcs(spark, sf_dir)))


def _walks(spark, sf_dir):
    named = ad.named_steps(spark, sf_dir)
    segs = ad.segments(named)
    return ad.steps(named, segs), segs


def _edges(steps):
    return ordering.consecutive(steps)


def _columns(steps, segs):
    return ordering.dense_columns(ordering.relax(ordering.seed_columns(steps, segs), _edges(steps)))


@book.query(f"WITH {ad.STEPS_SQL} SELECT walk_id, pos, seg_id FROM steps")
def walk_steps(spark, sf_dir):
    return _walks(spark, sf_dir)[0].withColumn("pos", F.col("pos").cast("long"))


_TURNS = """turns AS (SELECT o_custkey AS walk_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos,
        o_orderkey % 40 AS seg_id, o_orderstatus = 'F' OR o_orderkey % 5 = 0 AS rev FROM orders)"""


@book.query(
    f"""WITH {_TURNS}, ref AS (SELECT seg_id, arg_min(rev, row(walk_id, pos)) AS r FROM turns GROUP BY 1),
    vote AS (SELECT walk_id, sum(CASE WHEN rev = r THEN -1 ELSE 1 END) > 0 AS flipped, max(pos) AS last FROM turns JOIN ref USING (seg_id) GROUP BY 1)
    SELECT walk_id, CASE WHEN flipped THEN last - pos ELSE pos END AS pos, seg_id, rev <> flipped AS rev, flipped FROM turns JOIN vote USING (walk_id)"""
)
def walk_majority_flip(spark, sf_dir):
    return graph.flip_walks(_turns(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))


def _turns(spark, sf_dir):
    from pyspark.sql import Window

    o = ad.table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return o.select(F.col("o_custkey").alias("walk_id"), (F.row_number().over(w) - 1).alias("pos"), (F.col("o_orderkey") % 40).alias("seg_id"), ((F.col("o_orderstatus") == "F") | (F.col("o_orderkey") % 5 == 0)).alias("rev"))


@book.query(
    f"""WITH {_TURNS}, ref AS (SELECT seg_id, arg_min(rev, row(walk_id, pos)) AS r FROM turns GROUP BY 1),
    vote AS (SELECT walk_id, sum(CASE WHEN rev = r THEN -1 ELSE 1 END) > 0 AS flipped FROM turns JOIN ref USING (seg_id) GROUP BY 1)
    SELECT DISTINCT walk_id FROM turns JOIN vote USING (walk_id) WHERE rev <> flipped"""
)
def reverse_walks(spark, sf_dir):
    return graph.reverse_walks(graph.flip_walks(_turns(spark, sf_dir)))


@book.query(f"WITH {ad.STEPS_SQL} SELECT seg_id, string_agg(DISTINCT CAST(walk_id AS VARCHAR), ',' ORDER BY CAST(walk_id AS VARCHAR)) AS walks FROM steps GROUP BY seg_id")
def haplotypes_of(spark, sf_dir):
    h = graph.haplotypes_of(_walks(spark, sf_dir)[0])
    return h.select("seg_id", F.array_join(F.array_sort(F.transform("walks", lambda x: x.cast("string"))), ",").alias("walks"))


@book.query(f"WITH {ad.STEPS_SQL} SELECT x AS v, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out FROM (SELECT u AS x, 0 AS i, 1 AS o FROM edges UNION ALL SELECT v, 1, 0 FROM edges) GROUP BY x")
def degrees(spark, sf_dir):
    return graph.degrees(_edges(_walks(spark, sf_dir)[0]))


@book.query(
    f"""WITH {ad.LINKS_SQL}, x AS (SELECT a AS seg, ov + line % 40 AS least FROM ovl WHERE ov <> 2147483647 UNION ALL SELECT b, ow + line % 30 FROM ovl WHERE ow <> 2147483647)
    SELECT CAST(s.seg_id AS VARCHAR) AS name, CAST(greatest(any_value(s.len), coalesce(max(least), 0)) AS INTEGER) AS len FROM lsegs s LEFT JOIN x ON x.seg = s.seg_id GROUP BY s.seg_id"""
)
def implied_lengths(spark, sf_dir):
    """Segment lengths extended by what their links' L1 and L2 tags imply."""
    links = ad.link_records(spark, sf_dir).withColumns({"l1": (F.col("line") % 40).cast("int"), "l2": (F.col("line") % 30).cast("int")})
    none = F.lit(None).cast("string")
    segs = ad.link_segments(spark, sf_dir).select("name", F.col("seg_id").alias("line"), none.alias("seq"), "len", none.alias("sn"), F.lit(0).alias("so"), F.lit(0).alias("sr"))
    return graph.encode_segments(segs, links).join(segs.select("name"), "name", "left_semi").select("name", "len")


@book.query(f"WITH {ad.STEPS_SQL} SELECT seg_id, seg_id IN (SELECT seg_id FROM steps WHERE pos < 3) AS on_walk FROM segs")
def presence_flags(spark, sf_dir):
    """Segments that walks visit in their first three steps."""
    steps, segs = _walks(spark, sf_dir)
    return graph.presence(segs, steps.filter("pos < 3"))


@book.query(f"WITH {ad.STEPS_SQL}, e AS (SELECT * FROM edges WHERE u % 3 = 0) SELECT seg_id FROM segs WHERE seg_id NOT IN (SELECT u FROM e UNION SELECT v FROM e)")
def isolated_vertices(spark, sf_dir):
    """Segments that no edge touches once two thirds of the edges are gone."""
    steps, segs = _walks(spark, sf_dir)
    return graph.isolated(segs, _edges(steps).filter("u % 3 = 0"))


_SEED = "seed AS (SELECT s.seg_id, CAST(coalesce(min(pos), (SELECT max(pos) + 1 FROM steps)) AS BIGINT) AS col FROM segs s LEFT JOIN steps USING (seg_id) GROUP BY 1)"
_RELAX = f"""{_SEED}, push(seg_id, col) AS (SELECT seg_id, col FROM seed UNION SELECT e.v, p.col + 1 FROM push p JOIN edges e ON p.seg_id = e.u),
    relaxed AS (SELECT seg_id, max(col) AS col FROM push GROUP BY 1),
    cols AS (SELECT seg_id, dense_rank() OVER (ORDER BY col) - 1 AS col, row_number() OVER (ORDER BY col, seg_id) - 1 AS rank FROM relaxed)"""


@book.query(f"WITH {ad.STEPS_SQL}, {_SEED} SELECT seg_id, col FROM seed")
def seed_columns(spark, sf_dir):
    return ordering.seed_columns(*_walks(spark, sf_dir))


@book.query(f"WITH RECURSIVE {ad.STEPS_SQL}, {_RELAX} SELECT seg_id, col FROM relaxed")
def column_relax(spark, sf_dir):
    steps, segs = _walks(spark, sf_dir)
    return ordering.relax(ordering.seed_columns(steps, segs), _edges(steps))


@book.query(f"WITH RECURSIVE {ad.STEPS_SQL}, {_RELAX} SELECT seg_id, col, rank FROM cols")
def dense_columns(spark, sf_dir):
    return _columns(*_walks(spark, sf_dir))


@book.query(f"WITH RECURSIVE {ad.STEPS_SQL}, {_RELAX} SELECT u, v FROM edges JOIN cols a ON u = a.seg_id JOIN cols b ON v = b.seg_id WHERE b.col - a.col > 1")
def skip_edges(spark, sf_dir):
    steps, segs = _walks(spark, sf_dir)
    return ordering.skip_edges(steps, _columns(steps, segs))


@book.query(f"WITH RECURSIVE {ad.STEPS_SQL}, {_RELAX} SELECT u, string_agg(CAST(v AS VARCHAR), ',' ORDER BY col, v) AS out FROM edges JOIN cols ON v = seg_id GROUP BY u")
def sorted_adjacency(spark, sf_dir):
    steps, segs = _walks(spark, sf_dir)
    return ordering.sorted_adjacency(_edges(steps), _columns(steps, segs)).select("u", F.array_join("out", ",").alias("out"))


_LEVELS = """push(x, l) AS (SELECT seg_id, 0 FROM segs UNION SELECT e.v, p.l + 1 FROM push p JOIN edges e ON p.x = e.u),
    lev AS (SELECT x AS seg_id, CAST(max(l) AS BIGINT) AS col FROM push WHERE x IN (SELECT u FROM edges UNION SELECT v FROM edges) GROUP BY 1)"""


@book.query(f"WITH RECURSIVE {ad.STEPS_SQL}, {_LEVELS} SELECT seg_id, col FROM lev")
def longest_path_levels(spark, sf_dir):
    return ordering.levels(_edges(_walks(spark, sf_dir)[0]))


@book.query(f"WITH RECURSIVE {ad.STEPS_SQL}, {_LEVELS} SELECT u, v, unnest(range(a.col + 1, b.col)) AS level FROM edges JOIN lev a ON u = a.seg_id JOIN lev b ON v = b.seg_id")
def dummy_nodes(spark, sf_dir):
    e = _edges(_walks(spark, sf_dir)[0])
    return frames.dummies(ordering.levels(e), e)


@book.query(
    f"""WITH RECURSIVE {ad.STEPS_SQL}, {_LEVELS}, g AS (SELECT unnest(range(a.col + 1, b.col)) AS level FROM edges JOIN lev a ON u = a.seg_id JOIN lev b ON v = b.seg_id)
    SELECT level, count(*) AS n FROM (SELECT col AS level FROM lev UNION ALL SELECT level FROM g) GROUP BY level"""
)
def level_widths(spark, sf_dir):
    e = _edges(_walks(spark, sf_dir)[0])
    lev = ordering.levels(e)
    return frames.widths(lev, frames.dummies(lev, e))


_HAPS = f"""haps AS (SELECT walk_id, string_agg(seq, '' ORDER BY pos) AS seq FROM steps JOIN segs USING (seg_id) GROUP BY 1),
    hk AS (SELECT walk_id, seq, unnest(range(0, length(seq) - {HK - 1})) AS p FROM haps WHERE length(seq) >= {HK + HW - 1}),
    hc AS (SELECT walk_id, p, least(substr(seq, p + 1, {HK}), reverse(translate(substr(seq, p + 1, {HK}), 'ACGT', 'TGCA'))) AS km FROM hk),
    hm AS (SELECT walk_id, p, min(row(km, -p)) OVER (PARTITION BY walk_id ORDER BY p ROWS BETWEEN {HW - 1} PRECEDING AND CURRENT ROW) AS m FROM hc),
    hd AS (SELECT walk_id, p, m[1] AS key, CAST(-m[2] AS BIGINT) AS place, lag(m[1]) OVER (PARTITION BY walk_id ORDER BY p) AS prev FROM hm WHERE p >= {HW - 1}),
    hmin AS (SELECT walk_id, place, key FROM hd WHERE prev IS NULL OR prev <> key)"""
_SLICES = f"""pieces AS (SELECT walk_id * 1000 + i AS read_id, substr(seq, i * 48 + 1, 64) AS seq FROM (SELECT walk_id, seq, unnest(range(0, (length(seq) + 47) // 48)) AS i FROM haps)),
    rk AS (SELECT read_id, seq, unnest(range(0, length(seq) - {HK - 1})) AS p FROM pieces WHERE length(seq) >= {HK + HW - 1}),
    rc AS (SELECT read_id, p, least(substr(seq, p + 1, {HK}), reverse(translate(substr(seq, p + 1, {HK}), 'ACGT', 'TGCA'))) AS km FROM rk),
    rm AS (SELECT read_id, p, min(km) OVER (PARTITION BY read_id ORDER BY p ROWS BETWEEN {HW - 1} PRECEDING AND CURRENT ROW) AS key FROM rc),
    spec AS (SELECT key, count(DISTINCT read_id) AS multiplicity FROM rm WHERE p >= {HW - 1} GROUP BY key)"""
_ANCHORS = f"""{_HAPS}, {_SLICES},
    offs AS (SELECT walk_id, seg_id, sum(len) OVER (PARTITION BY walk_id ORDER BY pos) - len AS s, sum(len) OVER (PARTITION BY walk_id ORDER BY pos) AS e FROM steps JOIN segs USING (seg_id)),
    anchors AS (SELECT m.walk_id, place, key, list_sort(list(DISTINCT seg_id)) AS vtxs FROM hmin m JOIN spec USING (key)
        JOIN offs o ON o.walk_id = m.walk_id AND o.s < place + {HK} AND o.e > place GROUP BY 1, 2, 3),
    worst AS (SELECT key, max(n) AS n FROM (SELECT key, vtxs, count(*) AS n FROM anchors GROUP BY 1, 2) GROUP BY 1),
    kept AS (SELECT a.* FROM anchors a JOIN worst USING (key) WHERE worst.n < 0.5 * (SELECT count(DISTINCT walk_id) FROM steps))"""


def _haplotypes(spark, sf_dir):
    steps, segs = _walks(spark, sf_dir)
    return steps, segs, anc.haplotype_sequences(steps, segs)


def _hap_minimizers(haps):
    return mz.extract(haps, "walk_id", "seq", HK, HW)


def _slices(haps):
    piece = haps.select("walk_id", "seq", F.explode(F.expr("sequence(0, (length(seq) + 47) div 48 - 1)")).alias("i"))
    return piece.select((F.col("walk_id") * 1000 + F.col("i")).alias("read_id"), F.expr("substring(seq, cast(i * 48 + 1 as int), 64)").alias("seq"))


def _anchors(spark, sf_dir):
    steps, segs, haps = _haplotypes(spark, sf_dir)
    found = _hap_minimizers(haps)
    spectrum = mz.multiplicities(mz.extract_sets(_slices(haps), "read_id", "seq", HK, HW), HK)
    ranks = segs.select("seg_id", F.col("seg_id").alias("rank"))
    placed = anc.with_vertices(anc.match(found, spectrum), anc.offsets(steps, segs), ranks, HK)
    return found, placed, anc.drop_ubiquitous(placed, steps.select("walk_id").distinct().count(), 0.5)


@book.query(f"WITH {ad.STEPS_SQL}, {_HAPS} SELECT walk_id, CAST(length(seq) AS BIGINT) AS len, md5(seq) AS seq_md5 FROM haps")
def path_sequence(spark, sf_dir):
    return _haplotypes(spark, sf_dir)[2].select("walk_id", F.length("seq").cast("long").alias("len"), F.md5("seq").alias("seq_md5"))


@book.query(f"WITH {ad.STEPS_SQL} SELECT walk_id, CAST(sum(len) AS BIGINT) AS len FROM steps JOIN segs USING (seg_id) GROUP BY walk_id")
def haplotype_lengths(spark, sf_dir):
    return anc.haplotype_lengths(*_walks(spark, sf_dir))


@book.query(f"WITH {ad.STEPS_SQL}, {_HAPS} SELECT walk_id, place, key FROM hmin")
def hap_minimizers(spark, sf_dir):
    return _hap_minimizers(_haplotypes(spark, sf_dir)[2]).select("walk_id", F.col("pos").alias("place"), "key")


@book.query(f"WITH {ad.STEPS_SQL}, {_HAPS} SELECT n, count(*) AS keys FROM (SELECT key, count(DISTINCT walk_id) AS n FROM hmin GROUP BY key) GROUP BY n")
def shared_by_n(spark, sf_dir):
    return mz.shared_by(mz.extract_sets(_haplotypes(spark, sf_dir)[2], "walk_id", "seq", HK, HW))


@book.query(f"WITH {ad.STEPS_SQL}, {_ANCHORS} SELECT walk_id, place, key, list_aggregate(vtxs, 'string_agg', '_') || '_' AS path FROM anchors")
def anchor_join(spark, sf_dir):
    from ..functions.sequence import anchor_key

    return _anchors(spark, sf_dir)[1].select("walk_id", F.col("at").alias("place"), "key", anchor_key(F.col("vtxs")).alias("path"))


@book.query(f"WITH {ad.STEPS_SQL}, {_ANCHORS} SELECT walk_id, place, key, list_aggregate(vtxs, 'string_agg', ',') AS vtxs FROM kept")
def ubiquity_filter(spark, sf_dir):
    return _anchors(spark, sf_dir)[2].select("walk_id", F.col("at").alias("place"), "key", F.array_join("vtxs", ",").alias("vtxs"))


@book.query(
    f"""WITH {ad.STEPS_SQL}, {_ANCHORS} SELECT walk_id, m.n AS minimizers, coalesce(a.n, 0) AS matched, coalesce(k.n, 0) AS retained, coalesce(a.n, 0) - coalesce(k.n, 0) AS filtered
    FROM (SELECT walk_id, count(*) AS n FROM hmin GROUP BY 1) m LEFT JOIN (SELECT walk_id, count(*) AS n FROM anchors GROUP BY 1) a USING (walk_id)
    LEFT JOIN (SELECT walk_id, count(*) AS n FROM kept GROUP BY 1) k USING (walk_id)"""
)
def anchors_per_hap(spark, sf_dir):
    return anc.counts(*_anchors(spark, sf_dir))


@book.query(f"WITH {ad.STEPS_SQL} SELECT row_number() OVER (ORDER BY walk_id, pos) AS x, walk_id, pos, seg_id FROM steps")
def expanded_nodes(spark, sf_dir):
    return frames.copies(_walks(spark, sf_dir)[0]).withColumn("pos", F.col("pos").cast("long"))


@book.query(
    f"""WITH {ad.STEPS_SQL}, n AS (SELECT row_number() OVER (ORDER BY walk_id, pos) AS x, walk_id, pos FROM steps),
    e AS (SELECT x, lead(x) OVER w AS nxt, lag(x) OVER w AS prev FROM n WINDOW w AS (PARTITION BY walk_id ORDER BY pos))
    SELECT x AS u, coalesce(nxt, -1) AS v, 0 AS w FROM e UNION ALL SELECT 0, x, 0 FROM e WHERE prev IS NULL"""
)
def chain_edges(spark, sf_dir):
    return frames.chain_edges(frames.copies(_walks(spark, sf_dir)[0]))


@book.query(
    f"""WITH {ad.STEPS_SQL}, s AS (SELECT l.seg_id AS u, e.v FROM leads l JOIN edges e ON l.seg_id = e.u WHERE nxt IS NULL OR nxt <> e.v)
    SELECT u, v, count(*) AS n_in, (SELECT count(*) FROM steps WHERE seg_id = s.v) AS n_out FROM s GROUP BY u, v"""
)
def recomb_nodes(spark, sf_dir):
    steps, _ = _walks(spark, sf_dir)
    return frames.recombination_nodes(steps, _edges(steps))


@book.query(f"WITH {ad.STEPS_SQL} SELECT walk_id, pos, l.seg_id AS u, e.v FROM leads l JOIN edges e ON l.seg_id = e.u WHERE nxt IS NULL OR nxt <> e.v")
def recomb_edges(spark, sf_dir):
    steps, _ = _walks(spark, sf_dir)
    return frames.switches(steps, _edges(steps)).withColumn("pos", F.col("pos").cast("long"))


@book.query(f"WITH {ad.STEPS_SQL}, {_ANCHORS} SELECT walk_id, place, key, vtxs[1] AS first, vtxs[-1] AS last, len(vtxs) AS n FROM kept WHERE len(vtxs) > 1")
def anchor_supernodes(spark, sf_dir):
    return frames.super_nodes(_anchors(spark, sf_dir)[2]).withColumnRenamed("at", "place")


@book.query(
    f"""WITH {ad.STEPS_SQL}, {_ANCHORS} SELECT i.walk_id, i.key, i.place, count(*) AS n FROM kept i JOIN kept o ON i.walk_id = o.walk_id
        AND o.vtxs[1] <= i.vtxs[1] AND i.vtxs[-1] <= o.vtxs[-1] AND (o.key <> i.key OR o.place <> i.place) GROUP BY 1, 2, 3"""
)
def anchor_containment(spark, sf_dir):
    return frames.containments(_anchors(spark, sf_dir)[2]).withColumnRenamed("at", "place")


@book.query(f"WITH {ad.STEPS_SQL}, {_ANCHORS} SELECT key, row_number() OVER (ORDER BY key) - 1 AS color FROM (SELECT DISTINCT key FROM kept)")
def colour_ids(spark, sf_dir):
    return frames.colour_ids(_anchors(spark, sf_dir)[2])


@book.query(f"WITH {ad.STEPS_SQL}, {_ANCHORS} SELECT walk_id, count(DISTINCT key) AS colors, avg(n) AS ratio FROM (SELECT walk_id, key, count(*) AS n FROM kept GROUP BY 1, 2) GROUP BY 1")
def colours_on_path(spark, sf_dir):
    return frames.colours_on_path(_anchors(spark, sf_dir)[2], "walk_id", "key")
