"""Queries over the multiplicity model, levelled graphs and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames, metrics, mixture
from . import adapters as ad
from .book import Book

book = Book()

# A histogram that any scale gives: orders of a customer, counted.
_HIST = "hist AS (SELECT multiplicity, count(*) AS freq FROM (SELECT o_custkey, count(*) AS multiplicity FROM orders GROUP BY 1) GROUP BY 1)"


def _hist(spark, sf_dir):
    per = ad.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("multiplicity"))
    return per.groupBy("multiplicity").agg(F.count("*").alias("freq"))


_COPIES = range(1, 11)


def _zipf_sql(e: str, c: str) -> str:
    return f"(pow({c}, -({e})) / ({' + '.join(f'pow({k}.0, -({e}))' for k in _COPIES)}))"


def _curve_sql(x: str, mean: str, sd: str, e: str) -> str:
    terms = []
    for k in _COPIES:
        width = f"greatest(({sd}) * sqrt({k}.0), 1e-12)"
        terms.append(f"{_zipf_sql(e, f'{k}.0')} * 0.3989422804014327 / {width} * exp(-0.5 * pow(({x} - ({mean}) * {k}.0) / {width}, 2))")
    return f"greatest({' + '.join(terms)}, 1e-300)"


def _error_sql(x: str, s: str) -> str:
    return f"CASE WHEN {x} <= 0 THEN 0.0 ELSE greatest(pow({x}, -({s})) - pow({x} + 1, -({s})), 1e-300) END"


def _het_sql(x: str) -> str:
    return _curve_sql(x, "u * 0.5", "sqrt(greatest(var, 1e-12)) * 0.5", "zp_het")


def _mix_sql(x: str) -> str:
    return f"p_e * ({_error_sql(x, 's')}) + (1 - p_e) * (p_d * {_het_sql(x)} + (1 - p_d) * {_curve_sql(x, 'u', 'sd', 'zp')})"


# A small grid: two values on most axes, in nested order.
_AXES = {"u": (4.0, 8.0, 12.0), "sd": (0.5, 2.0), "var": (0.71, 4.0), "zp": (1.5, 3.0), "zp_het": (2.0,), "p_d": (0.1, 0.9), "p_e": (0.02, 0.1), "s": (2.0, 4.0)}
_GRID_SQL = "grid AS (SELECT row_number() OVER (ORDER BY {names}) - 1 AS idx, * FROM {axes})".format(
    names=", ".join(_AXES),
    axes=" CROSS JOIN ".join(f"(SELECT unnest([{', '.join(f'CAST({v} AS DOUBLE)' for v in vs)}]) AS {n})" for n, vs in _AXES.items()),
)
_NLL_SQL = f"{_HIST}, {_GRID_SQL}, nll AS (SELECT idx, sum(-CAST(freq AS DOUBLE) * ln({_mix_sql('CAST(multiplicity AS DOUBLE)')} + 1e-300)) AS nll FROM grid, hist GROUP BY idx)"


def _points(spark):
    import itertools

    rows = [(i, *p) for i, p in enumerate(itertools.product(*_AXES.values()))]
    return spark.createDataFrame(rows, "idx long, " + ", ".join(f"{n} double" for n in _AXES))


@book.query("SELECT e.v AS exponent, c.v AS copy, round(" + _zipf_sql("e.v", "CAST(c.v AS DOUBLE)") + ", 9) AS weight FROM (SELECT unnest([1.01, 2.0, 4.0])::DOUBLE AS v) e, (SELECT unnest(range(1, 11)) AS v) c")
def zipf_weights(spark, sf_dir):
    g = spark.createDataFrame([(e,) for e in (1.01, 2.0, 4.0)], "exponent double").select("exponent", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(10).cast("long"))).alias("copy"))
    return g.withColumn("weight", F.round(mixture.zipf_column(F.col("exponent"), F.col("copy")), 9))


@book.query(
    f"""WITH {_HIST}, p AS (SELECT CAST(multiplicity AS DOUBLE) AS x, multiplicity, 9.0::DOUBLE AS u, 1.5::DOUBLE AS sd, 2.0::DOUBLE AS var, 2.5::DOUBLE AS zp, 3.0::DOUBLE AS zp_het, 2.2::DOUBLE AS s FROM hist)
    SELECT multiplicity, round({_curve_sql('x', 'u', 'sd', 'zp')}, 9) AS hom, round({_het_sql('x')}, 9) AS het, round({_error_sql('x', 's')}, 9) AS err FROM p"""
)
def hom_het_curves(spark, sf_dir):
    x = F.col("multiplicity").cast("double")
    lit = lambda v: F.lit(float(v))
    return _hist(spark, sf_dir).select(
        "multiplicity",
        F.round(mixture.curve_column(x, lit(9), lit(1.5), lit(2.5)), 9).alias("hom"),
        F.round(mixture.curve_column(x, lit(9) * 0.5, F.sqrt(lit(2.0)) * 0.5, lit(3)), 9).alias("het"),
        F.round(mixture.error_column(x, lit(2.2)), 9).alias("err"),
    )


@book.query(f"WITH {_NLL_SQL} SELECT idx, round(nll, 4) AS nll FROM nll")
def nll_small_grid(spark, sf_dir):
    return mixture.nll_table(_hist(spark, sf_dir), _points(spark)).select("idx", F.round("nll", 4).alias("nll"))


@book.query(f"WITH {_NLL_SQL} SELECT idx, round(nll, 4) AS nll FROM nll ORDER BY nll, idx LIMIT 1")
def grid_argmin_small(spark, sf_dir):
    best = mixture.nll_table(_hist(spark, sf_dir), _points(spark)).agg(F.min(F.struct("nll", "idx")).alias("m"))
    return best.select("m.idx", F.round("m.nll", 4).alias("nll"))


@book.query()
def grid_fit_full(spark, sf_dir):
    """The whole grid of 2,100,875 points; its parameters and likelihood."""
    return spark.createDataFrame([mixture.as_row(mixture.fit(_hist(spark, sf_dir)))])


_FIXED = mixture.Fit(u=12.0, sd=2.0, var=4.0, zp=2.0, zp_het=2.0, p_d=0.5, p_e=0.05, s=2.0)
_LABEL_SQL = f"""{_HIST}, p AS (SELECT CAST(multiplicity AS DOUBLE) AS x, multiplicity, freq, 12.0::DOUBLE AS u, 2.0::DOUBLE AS sd, 4.0::DOUBLE AS var, 2.0::DOUBLE AS zp, 2.0::DOUBLE AS zp_het FROM hist),
    lab AS (SELECT multiplicity, freq, CASE WHEN multiplicity = 1 OR 0.95 * 0.5 * {_het_sql('x')} >= 0.95 * 0.5 * {_curve_sql('x', 'u', 'sd', 'zp')} THEN 'HET' ELSE 'HOM' END AS label FROM p)"""


@book.query(f"WITH {_LABEL_SQL} SELECT multiplicity, freq, label FROM lab")
def classify_minimizers(spark, sf_dir):
    return mixture.label(_hist(spark, sf_dir), _FIXED).select("multiplicity", "freq", "label")


@book.query(f"WITH {_LABEL_SQL} SELECT label, CAST(sum(freq) AS BIGINT) AS n, round(100.0 * sum(freq) / (SELECT sum(freq) FROM lab), 4) AS pct FROM lab GROUP BY label")
def label_summary(spark, sf_dir):
    lab = mixture.label(_hist(spark, sf_dir), _FIXED)
    total = lab.agg(F.sum("freq").alias("total"))
    return lab.groupBy("label").agg(F.sum("freq").alias("n")).crossJoin(F.broadcast(total)).select("label", "n", F.round(F.col("n") * 100.0 / F.col("total"), 4).alias("pct"))


@book.query(
    f"""WITH {_HIST}, d AS (SELECT m.v AS multiplicity, CAST(coalesce(freq, 0) AS DOUBLE) AS y FROM (SELECT unnest(range(0, (SELECT max(multiplicity) + 1 FROM hist))) AS v) m LEFT JOIN hist ON m.v = multiplicity)
    SELECT multiplicity, round(avg(y) OVER (ORDER BY multiplicity ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS smooth FROM d"""
)
def moving_avg_valley(spark, sf_dir):
    return mixture.moving_average(_hist(spark, sf_dir)).select("multiplicity", F.round("smooth", 6).alias("smooth"))


# Levelled graph of days and event types: colours are groups of users, even ones are two-copy.
COLORS, BUDGET = 24, 3
_GRAPH_SQL = f"""ev AS (SELECT CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS INTEGER) AS day, event_type AS kind, event_id, user_id, ts, value FROM events),
    kinds AS (SELECT kind, row_number() OVER (ORDER BY kind) AS k FROM (SELECT DISTINCT kind FROM ev)),
    cs AS (SELECT day, k, list_sort(list(DISTINCT CAST(CASE WHEN value > 0 THEN user_id + k * 5 ELSE 0 END % {COLORS} AS INTEGER)) FILTER (WHERE value > 0 AND (user_id + day) % 6 = k % 6)) AS cs FROM ev JOIN kinds USING (kind) GROUP BY 1, 2),
    top AS (SELECT max(day) + 2 AS sink FROM ev),
    nodes AS (SELECT (day + 1) * 100 + k AS x, day + 1 AS level, coalesce(cs, []) AS cs FROM cs UNION ALL SELECT 0, 0, [] UNION ALL SELECT sink * 100, sink, [] FROM top),
    pairs AS (SELECT a.x AS u, b.x AS v, a.level FROM nodes a JOIN nodes b ON b.level = a.level + 1),
    edges AS (SELECT u, v, level, CASE WHEN u = 0 OR v % 100 = 0 OR u % 100 = v % 100 THEN 0 ELSE 1 END AS w FROM pairs)"""


def _graph(spark, sf_dir):
    """Nodes and edges of the levelled graph; every pair of neighbours is an edge, changing type costs 1."""
    e = ad.table(spark, sf_dir, "events").withColumn("day", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")))
    names = e.select("event_type").distinct().agg(F.array_sort(F.collect_list("event_type")).alias("names"))
    e = e.crossJoin(F.broadcast(names)).withColumn("k", F.array_position("names", F.col("event_type")).cast("int"))
    hit = (F.col("value") > 0) & ((F.col("user_id") + F.col("day")) % 6 == F.col("k") % 6)
    cs = e.groupBy("day", "k").agg(F.array_sort(F.collect_set(F.when(hit, ((F.col("user_id") + F.col("k") * 5) % COLORS).cast("int")))).alias("cs"))
    inner = cs.select(((F.col("day") + 1) * 100 + F.col("k")).alias("x"), (F.col("day") + 1).alias("level"), "cs")
    last = e.agg((F.max("day") + 2).alias("sink"))
    empty = F.array().cast("array<int>")
    nodes = inner.union(last.select(F.lit(0), F.lit(0), empty)).union(last.select(F.col("sink") * 100, "sink", empty))
    nodes = nodes.select(F.lit(0).cast("long").alias("grp"), F.col("x").cast("long"), "level", "cs")
    a, b = nodes.select(F.col("x").alias("u"), "level"), nodes.select(F.col("x").alias("v"), (F.col("level") - 1).alias("level"))
    same = (F.col("u") == 0) | (F.col("v") % 100 == 0) | (F.col("u") % 100 == F.col("v") % 100)
    edges = a.join(b, "level").select(F.lit(0).cast("long").alias("grp"), "u", "v", F.when(same, 0).otherwise(1).alias("w"), "level")
    return nodes, edges


_HOMS = "[" + ", ".join(str(c) for c in range(0, COLORS, 2)) + "]::INTEGER[]"
_UNION = "list_distinct(list_concat({a}, {b}))"


def _split(a: str, homs: bool) -> str:
    return f"list_filter({a}.cs, lambda c: c % 2 = {0 if homs else 1})"


def _delta_sql() -> tuple[str, str]:
    def both(x: str, y: str, homs: bool) -> str:
        return _UNION.format(a=_split(x, homs), b=_split(y, homs))

    hom = f"len(list_intersect({both('a', 'b', True)}, {both('c', 'd', True)}))"
    now, nxt = both("a", "b", False), both("c", "d", False)
    het = f"(len({now}) + len({nxt}) - 2 * len(list_intersect({now}, {nxt})))"
    return hom, het


_HOM_SQL, _HET_SQL = _delta_sql()
_SCORES_SQL = f"""{_GRAPH_SQL}, scores AS (SELECT e.u AS u1, f.u AS v1, e.v AS u2, f.v AS v2, e.w + f.w AS w, e.level, CAST({_HOM_SQL} AS BIGINT) AS hom_shared, CAST({_HET_SQL} AS BIGINT) AS het_single
    FROM edges e JOIN edges f ON e.level = f.level JOIN nodes a ON a.x = e.u JOIN nodes b ON b.x = f.u JOIN nodes c ON c.x = e.v JOIN nodes d ON d.x = f.v)"""


@book.query(f"WITH {_SCORES_SQL} SELECT u1, v1, u2, v2, hom_shared, het_single FROM scores")
def pair_scores(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    homs = spark.range(0, COLORS, 2).select(F.col("id").cast("int").alias("c"))
    return frames.pair_scores(edges, nodes.select("x", "cs"), homs)


def _solved(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    homs = F.array(*[F.lit(c) for c in range(0, COLORS, 2)])
    return frames.solve(nodes.withColumn("homs", homs), edges.drop("level"), BUDGET)


_HAPLOID_SQL = f"""WITH RECURSIVE {_GRAPH_SQL}, dp(level, x, r, score) AS (SELECT 0, CAST(0 AS BIGINT), unnest(range(0, {BUDGET + 1})), CAST(0 AS BIGINT)
    UNION ALL SELECT d.level + 1, CAST(e.v AS BIGINT), d.r + e.w, CAST(max(d.score + len(n.cs)) AS BIGINT) FROM dp d JOIN edges e ON d.x = e.u JOIN nodes n ON n.x = e.v WHERE d.r + e.w <= {BUDGET} GROUP BY 1, 2, 3)
    SELECT CAST(r AS INTEGER) AS r, score FROM dp, top WHERE dp.level = sink"""


@book.query(_HAPLOID_SQL)
def haploid_dp(spark, sf_dir):
    return _solved(spark, sf_dir).select("r", F.col("haploid").alias("score"))


@book.query(
    f"""WITH RECURSIVE {_SCORES_SQL}, dp(level, x, y, r, score) AS (SELECT 0, CAST(0 AS BIGINT), CAST(0 AS BIGINT), unnest(range(0, {BUDGET + 1})), CAST(0 AS BIGINT)
    UNION ALL SELECT d.level + 1, CAST(s.u2 AS BIGINT), CAST(s.v2 AS BIGINT), d.r + s.w, CAST(max(d.score + s.hom_shared + s.het_single) AS BIGINT)
        FROM dp d JOIN scores s ON d.x = s.u1 AND d.y = s.v1 AND d.level = s.level WHERE d.r + s.w <= {BUDGET} GROUP BY 1, 2, 3, 4)
    SELECT CAST(r AS INTEGER) AS r, score FROM dp, top WHERE dp.level = sink"""
)
def diploid_dp(spark, sf_dir):
    return _solved(spark, sf_dir).select("r", F.col("diploid").alias("score"))


_HAPLOID_ANY_SQL = f"""WITH RECURSIVE {_GRAPH_SQL}, dp(level, x, r, score) AS (SELECT level, CAST(x AS BIGINT), unnest(range(0, {BUDGET + 1})), CAST(0 AS BIGINT) FROM nodes
    UNION ALL SELECT d.level + 1, CAST(e.v AS BIGINT), d.r + e.w, CAST(max(d.score + len(n.cs)) AS BIGINT) FROM dp d JOIN edges e ON d.x = e.u JOIN nodes n ON n.x = e.v WHERE d.r + e.w <= {BUDGET} GROUP BY 1, 2, 3)
    SELECT CAST(r AS INTEGER) AS r, max(score) AS score FROM dp, top WHERE dp.level = sink GROUP BY 1"""


@book.query(_HAPLOID_ANY_SQL)
def haploid_dp_any_start(spark, sf_dir):
    """The default: a path may start at any node, with a score of 0."""
    nodes, edges = _graph(spark, sf_dir)
    homs = F.array(*[F.lit(c) for c in range(0, COLORS, 2)])
    return frames.solve(nodes.withColumn("homs", homs), edges.drop("level"), BUDGET, full_path=False).select("r", F.col("haploid").alias("score"))


@book.query(f"WITH {_GRAPH_SQL} SELECT level, count(*) FILTER (WHERE w > 0) AS n FROM edges GROUP BY 1")
def weighted_edges(spark, sf_dir):
    return frames.weighted_edges(_graph(spark, sf_dir)[1], "level")


@book.query(
    """WITH c AS (SELECT user_id, day, count(*) AS n FROM (SELECT user_id, CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS INTEGER) AS day FROM events) GROUP BY 1, 2),
    d AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY day) - 1 AS r, lead(n) OVER (PARTITION BY user_id ORDER BY day) - n AS gain FROM c),
    m AS (SELECT user_id, max(abs(gain)) AS top FROM d GROUP BY 1)
    SELECT user_id AS grp, coalesce(min(CASE WHEN gain IS NOT NULL AND top > 0 AND degrees(atan(CAST(gain AS DOUBLE) / top)) < 5 THEN r END), 0) AS best FROM d JOIN m USING (user_id) GROUP BY 1"""
)
def elbow_r(spark, sf_dir):
    """The elbow rule over each user's daily counts."""
    from pyspark.sql import Window

    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    c = ad.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("grp"), day.alias("day")).agg(F.count("*").alias("distinct"))
    return frames.elbows(c.withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy("day")) - 1))


@book.query(
    """WITH p AS (SELECT o_custkey AS grp, o_orderkey % 2 AS path, o_orderkey % 9 AS color, count(*) AS k FROM orders GROUP BY 1, 2, 3),
    c AS (SELECT grp, color, color % 2 = 0 AS hom, coalesce(max(CASE WHEN path = 0 THEN k END), 0) AS k1, coalesce(max(CASE WHEN path = 1 THEN k END), 0) AS k2 FROM p GROUP BY 1, 2, 3),
    s AS (SELECT grp, count(*) FILTER (WHERE hom AND k1 > 0 AND k2 > 0) AS i, count(*) FILTER (WHERE NOT hom AND (k1 = 0 OR k2 = 0)) AS s,
        CAST(sum(CASE WHEN hom AND k1 > 0 AND k2 > 0 THEN greatest(k1, k2) END) AS DOUBLE) AS mi, CAST(sum(CASE WHEN NOT hom AND (k1 = 0 OR k2 = 0) THEN k1 + k2 END) AS DOUBLE) AS ms FROM c GROUP BY 1)
    SELECT grp, i + s AS objective, round(mi / nullif(i, 0), 6) AS m_hom, round(ms / nullif(s, 0), 6) AS m_het FROM s"""
)
def certificate(spark, sf_dir):
    """Certificate parts of pairs of coloured paths, one pair for each customer."""
    o = ad.table(spark, sf_dir, "orders")
    k = lambda p: F.sum(F.when(F.col("o_orderkey") % 2 == p, 1).otherwise(0))
    color = F.col("o_orderkey") % 9
    c = o.groupBy(F.col("o_custkey").alias("grp"), color.alias("color")).agg(k(0).alias("k1"), k(1).alias("k2"))
    out = frames.certificates(c.withColumn("hom", F.col("color") % 2 == 0))
    return out.select("grp", "objective", F.round("m_hom", 6).alias("m_hom"), F.round("m_het", 6).alias("m_het"))


_VARIANTS = """v AS (SELECT p_brand AS chrom, p_partkey AS pos, repeat('A', p_size) AS ref, [repeat('C', p_size + CAST(p_partkey % 120 AS INTEGER)), 'G'] AS alts FROM part)"""


@book.query(f"WITH {_VARIANTS} SELECT chrom, CAST(sum(CASE WHEN abs(length(alt) - length(ref)) >= 50 THEN 1 ELSE 0 END) AS BIGINT) AS n_sv FROM (SELECT chrom, ref, unnest(alts) AS alt FROM v) GROUP BY chrom")
def sv_count(spark, sf_dir):
    return metrics.sv_count(_variants(spark, sf_dir))


def _variants(spark, sf_dir):
    p = ad.table(spark, sf_dir, "part")
    return p.select(F.col("p_brand").alias("chrom"), F.col("p_partkey").alias("pos"), F.expr("repeat('A', p_size)").alias("ref"), F.array(F.expr("repeat('C', p_size + cast(p_partkey % 120 as int))"), F.lit("G")).alias("alts"))


@book.query("SELECT source AS sample, string_agg(printf('%.2f', round(length(text) / 1e6, 2)), '|' ORDER BY doc_id) AS mb FROM documents GROUP BY source")
def assembly_length(spark, sf_dir):
    d = ad.table(spark, sf_dir, "documents")
    return metrics.assembly_length(d.select(F.col("source").alias("sample"), F.col("doc_id").alias("name"), F.col("text").alias("seq")))


@book.query(
    """WITH s AS (SELECT l_suppkey AS sample, l_orderkey AS pos, l_linenumber AS alt, l_partkey AS id, (CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS s, l_quantity, l_extendedprice FROM lineitem),
    l AS (SELECT *, lag(s) OVER (PARTITION BY sample ORDER BY pos, alt, id, l_quantity, l_extendedprice, s) AS p FROM s)
    SELECT sample, count(p) AS pairs, CAST(sum(CASE WHEN s <> p THEN 1 ELSE 0 END) AS BIGINT) AS switches, CASE WHEN count(p) > 0 THEN sum(CASE WHEN s <> p THEN 1 ELSE 0 END) / count(p)::DOUBLE END AS rate FROM l GROUP BY sample"""
)
def switch_error(spark, sf_dir):
    c = ad.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sample"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag")
    c = c.withColumn("same", F.col("l_returnflag") == "R")
    return metrics.switch_errors(c, ["sample"], ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "same"], F.col("same"))


@book.query(
    """WITH t AS (SELECT DISTINCT l_suppkey AS sample, l_partkey AS pos FROM lineitem WHERE l_returnflag <> 'A'), c AS (SELECT DISTINCT l_suppkey AS sample, l_partkey AS pos FROM lineitem WHERE l_returnflag <> 'N'),
    j AS (SELECT coalesce(t.sample, c.sample) AS sample, t.pos IS NOT NULL AS it, c.pos IS NOT NULL AS ic FROM t FULL JOIN c ON t.sample = c.sample AND t.pos = c.pos),
    n AS (SELECT sample, count(*) FILTER (WHERE it AND ic) AS tp, count(*) FILTER (WHERE NOT it) AS fp, count(*) FILTER (WHERE NOT ic) AS fn FROM j GROUP BY 1)
    SELECT sample, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE END AS recall,
        CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE END AS f1 FROM n"""
)
def prf1(spark, sf_dir):
    x = ad.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("pos"), "l_returnflag")
    return metrics.precision_recall(x.filter("l_returnflag <> 'A'"), x.filter("l_returnflag <> 'N'"), ["pos"], ["sample"])


@book.query(
    """WITH t AS (SELECT DISTINCT l_suppkey AS sample, l_partkey * 50 AS pos, CAST(l_quantity AS BIGINT) AS size FROM lineitem WHERE l_returnflag <> 'A'),
    c AS (SELECT DISTINCT l_suppkey AS sample, l_partkey * 50 AS pos, CAST(l_quantity AS BIGINT) AS size FROM lineitem WHERE l_returnflag = 'A'),
    m AS (SELECT t.sample, t.pos AS tp, t.size AS ts, c.pos AS cp, c.size AS cs FROM t JOIN c ON t.sample = c.sample AND abs(t.pos - c.pos) <= 500 AND least(t.size, c.size) >= 0.7 * greatest(t.size, c.size)),
    n AS (SELECT sample, (SELECT count(*) FROM t WHERE t.sample = s.sample) AS nt, (SELECT count(*) FROM c WHERE c.sample = s.sample) AS nc,
        (SELECT count(*) FROM (SELECT DISTINCT tp, ts FROM m WHERE m.sample = s.sample)) AS tp, (SELECT count(*) FROM (SELECT DISTINCT cp, cs FROM m WHERE m.sample = s.sample)) AS tc
        FROM (SELECT sample FROM t UNION SELECT sample FROM c) s),
    q AS (SELECT sample, tp, nc - tc AS fp, nt - tp AS fn, CASE WHEN nc > 0 THEN tc / nc::DOUBLE END AS precision, CASE WHEN nt > 0 THEN tp / nt::DOUBLE END AS recall FROM n)
    SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END AS f1 FROM q"""
)
def prf1_by_size(spark, sf_dir):
    """Variants matched within 500 positions and 0.7 of their size."""
    x = ad.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sample"), (F.col("l_partkey") * 50).alias("pos"), F.col("l_quantity").cast("long").alias("size"), "l_returnflag")
    return metrics.matched_by_size(x.filter("l_returnflag <> 'A'"), x.filter("l_returnflag = 'A'"), ["sample"])


@book.query(
    """WITH c AS (SELECT conv_id, turn, role, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    r AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM c)
    SELECT conv_id, role, min(turn) AS first, max(turn) AS last FROM r GROUP BY conv_id, run, role"""
)
def recombination_runs(spark, sf_dir):
    """Run-length report of neighbours with one label."""
    return metrics.gaps_and_islands(ad.table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role")


@book.query(f"WITH {_VARIANTS} SELECT chrom, pos, i - 1 AS alt_no, alts[i] AS alt FROM (SELECT *, unnest(range(1, 3)) AS i FROM v)")
def split_alts(spark, sf_dir):
    from ..sources import vcf

    return vcf.split_alts(_variants(spark, sf_dir)).select("chrom", "pos", F.col("alt_no").cast("long").alias("alt_no"), "alt")
