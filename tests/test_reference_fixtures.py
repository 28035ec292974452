"""Toy graphs with hand-modelled expectations (FIXTURES.md), end to end and by kernel."""

import gzip

import random

import pytest
from strandweave.config import EngineConfig, parse
from strandweave.functions.murmur import murmur64_of
from strandweave.operators import dp, expanded, frames, graph, minimizers, mixture, ordering
from strandweave.plans import infer
from strandweave.sources import fasta, gfa, vcf

TOY1 = (
    "H\tVN:Z:1.1\n"
    + "".join(f"S\ts{i + 1}\t{s}\n" for i, s in enumerate(["ATCG", "ATC", "AAA", "ATAC", "TTAC", "TGAC", "GCAT", "CATG"]))
    + "".join(f"L\ts{a}\t+\ts{b}\t+\t0M\n" for a, b in [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (4, 6), (4, 7), (5, 8), (6, 8), (7, 8)])
    + "".join(f"W\tx{h}\t{h}\tc\t0\t3\t{w}\n" for h, w in enumerate([">s1>s2>s4>s7>s8", ">s1>s2>s4>s6>s8", ">s1>s3>s4>s7>s8", ">s1>s3>s4>s6>s8", ">s1>s3>s4>s5>s8"]))
)
READ1 = "ATCGATCATACTTACCATG"
LEFT, RIGHT = "ACGTCATGCAGTCGTAACGTAGTCGTCACAGTCAGTCGTAGCTA", "GTAGCGTCAGTCAGTCAGTCGTAGCGTAACGTCGTAGTCAGT"
TOY2 = f"S\t1\t{LEFT}\nS\t2\tA\nS\t3\tT\nS\t4\t{RIGHT}\nL\t1\t+\t2\t+\t0M\nL\t1\t+\t3\t+\t0M\nL\t2\t+\t4\t+\t0M\nL\t3\t+\t4\t+\t0M\nW\ta\t0\tc\t0\t3\t>1>2>4\nW\tb\t1\tc\t0\t3\t>1>3>4\n"


def test_murmur_vectors():
    assert murmur64_of(b"") == 0
    assert murmur64_of(b"hello") == 0x90C637D90913861B
    assert murmur64_of(b"ACGTCATGCAGTCGTAACGTAGTCGTCACAG") == 0xE7D6587DDD9CCD5B


@pytest.mark.parametrize("k,w", [(5, 3), (11, 4), (31, 25)])
def test_minimizer_sets_survive_reverse_complement(k, w):
    rng = random.Random(k)
    s = "".join(rng.choice("ACGTacgtN") for _ in range(500))
    back = s.upper()[::-1].translate(str.maketrans("ACGT", "TGCA"))
    keys = lambda t: {x for _, x in minimizers.listed(t.encode(), k, w)}
    assert keys(s) == keys(back)


def _kernel(seqs, adjacency, paths, read, k, w):
    spectrum = sorted({x for _, x in minimizers.listed(read.encode(), k, w)}, key=lambda x: murmur64_of(x.encode()))
    mid = {x: i for i, x in enumerate(spectrum)}
    anchors = []
    for h, p in enumerate(paths):
        owner = [v for v in p for _ in seqs[v]]
        for at, x in minimizers.listed("".join(seqs[v] for v in p).encode(), k, w):
            if x in mid:
                anchors.append((mid[x], h, list(dict.fromkeys(owner[at : at + k]))))
    g, spans, keys = expanded.expand(paths, adjacency, sorted(anchors))
    return spectrum, anchors, g, spans, keys


def test_first_toy_graph():
    seqs = ["ATCG", "ATC", "AAA", "ATAC", "TTAC", "TGAC", "GCAT", "CATG"]
    paths = [[0, 1, 3, 6, 7], [0, 1, 3, 5, 7], [0, 2, 3, 6, 7], [0, 2, 3, 5, 7], [0, 2, 3, 4, 7]]
    adjacency = {0: [1, 2], 1: [3], 2: [3], 3: [4, 5, 6], 4: [7], 5: [7], 6: [7]}
    spectrum, anchors, g, _, keys = _kernel(seqs, adjacency, paths, READ1, 5, 3)
    assert len(spectrum) == 7 and [sum(a[1] == h for a in anchors) for h in range(5)] == [3, 4, 2, 2, 5]
    assert (len(g.out), len(g.edges()), sum(w for *_, w in g.edges()), len(keys)) == (48, 94, 15, 7)
    t = expanded.topological(g)
    one = dp.haploid(t, 3)
    assert one.value == [8] * 4 and one.distinct == [5] * 4 and one.best_r == 0 and one.path == [0, 2, 3, 4, 7]
    lev = expanded.levelize(t)
    assert (max(lev.level) + 1, max(expanded.widths(lev)), len(lev.out)) == (12, 15, 91)
    assert all(lev.level[v] == lev.level[u] + 1 for u, v, _ in lev.edges())
    assert dp.diploid(lev, 3, [False] * 7).value[-1] == 14 and dp.diploid(lev, 3, [True] * 7).value[-1] == 4


def test_second_toy_graph():
    _, anchors, g, _, keys = _kernel([LEFT, "A", "T", RIGHT], {0: [1, 2], 1: [3], 2: [3]}, [[0, 1, 3], [0, 2, 3]], LEFT + "T" + RIGHT, 31, 25)
    assert [sum(a[1] == h for a in anchors) for h in range(2)] == [0, 3]
    assert (len(g.out), len(g.edges()), len(keys)) == (12, 18, 3)
    t = expanded.topological(g)
    assert dp.haploid(t, 3).value[-1] == 6 and dp.haploid(t, 3).path == [0, 2, 3]
    lev = expanded.levelize(t)
    assert (max(lev.level) + 1, max(expanded.widths(lev)), len(lev.out)) == (6, 6, 16)
    assert dp.diploid(lev, 3, [False] * 3).value[-1] == 8 and dp.diploid(lev, 3, [True] * 3).value[-1] == 3


def test_diploid_budget_and_naive_program():
    import itertools
    import random

    rng = random.Random(2)
    g = expanded.HapGraph()
    rows = [[g.node(0, [0])]] + [[g.node(h, [h]) for h in range(3)] for _ in range(5)] + [[g.node(0, [0])]]
    g.level = [lv for lv, row in enumerate(rows) for _ in row]
    g.source, g.sink = 0, len(g.out) - 1
    for a, b in itertools.pairwise(rows):
        for u in a:
            for v in b:
                if len(a) == 1 or len(b) == 1 or u % 3 == v % 3 or rng.random() < 0.5:
                    g.out[u].append((v, 0 if len(a) == 1 or len(b) == 1 or u % 3 == v % 3 else 1))
    for x in range(len(g.out)):
        g.colors[x] = sorted(rng.sample(range(6), rng.randint(0, 3)))
    hom = [c % 2 == 0 for c in range(6)]

    def score(u1, v1, u2, v2):
        h, t = ([{c for x in p for c in g.colors[x] if hom[c] == kind} for p in ((u1, v1), (u2, v2))] for kind in (True, False))
        return len(h[0] & h[1]) + len(t[0] ^ t[1])

    best = {}

    def walk(u, v, r, s):
        if u == g.sink:
            best[r] = max(best.get(r, -1), s)
            return
        for a, wa in g.out[u]:
            for b, wb in g.out[v]:
                walk(a, b, r + wa + wb, s + score(u, v, a, b))

    walk(0, 0, 0, 0)
    got = dp.diploid(g, 3, hom)
    assert got.value == [max(s for r, s in best.items() if r <= cap) for cap in range(4)]
    for path in got.paths:
        assert all(v in [x for x, _ in g.out[u]] for u, v in itertools.pairwise(path))


def test_cycle_is_an_error():
    g = expanded.HapGraph()
    a, b, c = (g.node(0, []) for _ in range(3))
    g.out = [[(b, 0)], [(c, 0)], [(b, 0)]]
    g.sink = c
    with pytest.raises(ValueError):
        expanded.topological(g)


def test_bridges_and_compaction():
    g = expanded.HapGraph()
    for _ in range(6):
        g.node(0, [0])
    g.out = [[(1, 0)], [(2, 0), (3, 0)], [(4, 0)], [(4, 0)], [(5, 0)], []]
    g.source, g.sink = 0, 5
    assert expanded.bridges(g) == [(0, 1), (4, 5)]
    assert len(expanded.compact(g).out) <= 6


@pytest.fixture(scope="module")
def toy(tmp_path_factory):
    d = tmp_path_factory.mktemp("toy")
    (d / "one.gfa").write_text(TOY1)
    with gzip.open(d / "two.gfa.gz", "wt") as f:
        f.write(TOY2)
    (d / "one.fa").write_text(f">r comment\n{READ1[:9]}\n{READ1[9:]}\n")
    (d / "two.fa").write_text(f">r\n{LEFT}T{RIGHT}\n")
    return d


def test_end_to_end(spark, toy):
    haploid = infer.run_files(spark, str(toy / "two.gfa.gz"), str(toy / "two.fa"), str(toy / "out"), EngineConfig(ploidy=1, recombinations=3)).collect()
    assert [(r["name"], r["seq"], r["recombinations"]) for r in haploid] == [("dp_sol", LEFT + "T" + RIGHT, 0)]
    lines = [x for p in sorted((toy / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == [">dp_sol LN:87", (LEFT + "T" + RIGHT)[:80], (LEFT + "T" + RIGHT)[80:]]
    pan = infer.Pangenome(gfa.read_gfa(spark, str(toy / "one.gfa")))
    two = infer.infer(pan, fasta.reads(spark, str(toy / "one.fa")), EngineConfig(k=5, w=3, recombinations=3)).orderBy("name").collect()
    assert [r["name"] for r in two] == ["sol_1", "sol_2"] and all(len(r["seq"]) == 19 for r in two) and {r["score"] for r in two} == {14}


def test_gfa_details(spark):
    text = "S\ta\t*\tLN:i:7\tSN:Z:chr\tSO:i:3\tSR:i:0\nS\tb\tacgt\nL\ta\t+\tb\t-\t*\nL\ta\t?\tb\t-\t1M\nL\tb\t+\tc\t+\t:4\nx\nP\tp\ta+\nW\ts\t1\tc\t0\t9\t>a<b>zz\nW\ts\tq\tc\t0\t9\t>a\n"
    rows = [(i, x) for i, x in enumerate(text.splitlines())]
    t = gfa.parse(spark.createDataFrame(rows, "line long, value string"))
    segs = graph.encode_segments(t.segments, t.links)
    assert {r["name"]: (r["seg_id"], r["len"]) for r in segs.collect()} == {"a": (0, 7), "b": (1, 4), "c": (2, 0)}
    assert {r["line"] for r in t.rejects.collect()} == {3, 8}
    walks = t.walks.withColumnRenamed("line", "walk_id")
    steps = graph.walk_table(walks, graph.defined(segs)).orderBy("pos").collect()
    assert [(r["pos"], r["seg_id"], r["rev"]) for r in steps] == [(0, 0, False), (1, 1, True)]
    arcs = graph.arcs_of(t.links, segs)
    assert arcs.count() == 2 and graph.normalise(arcs, segs).count() == 2


def test_fasta_and_fastq_records(spark, tmp_path):
    assert list(fasta.records([">a x", "AC", "GT", ">b", "", "TT"])) == [("a", "ACGT"), ("b", "TT")]
    assert list(fasta.records(["@a", "ACGT", "+", "!!!!", "@b", "AC", "+", "!!!", "@c", "A", "+", "!"])) == [("a", "ACGT")]
    with gzip.open(tmp_path / "r.fq.gz", "wt") as f:
        f.write("@q1 z\nACGT\n+\nIIII\n")
    assert [(r["name"], r["seq"]) for r in fasta.reads(spark, str(tmp_path / "r.fq.gz")).collect()] == [("q1", "ACGT")]


def test_vcf_graph(spark, tmp_path):
    (tmp_path / "v.vcf").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\n1\t3\t.\tG\tT,GA\t.\t.\t.\tGT\t1|2\n1\t6\t.\tC\tA\t.\t.\t.\tGT\t0|1\n")
    ref = spark.createDataFrame([("1", "ACGTACGT")], "name string, seq string")
    segs, links, walks = vcf.build_graph(vcf.read_vcf(spark, str(tmp_path / "v.vcf")), ref)
    seq = {r["name"]: r["seq"] for r in segs.collect()}
    hap = {r["hap"]: "".join(seq[s["name"]] for s in r["steps"]) for r in walks.collect()}
    assert hap == {0: "ACTTACGT", 1: "ACGATAAGT"} and links.count() > 4


def test_relaxation_forms_agree(spark):
    cols = spark.createDataFrame([(i, 0) for i in range(6)], "seg_id long, col long")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (0, 3), (3, 2), (2, 4)], "u long, v long")
    want = {0: 0, 1: 1, 2: 2, 3: 1, 4: 3, 5: 0}
    assert {r["seg_id"]: r["col"] for r in ordering.relax(cols, pairs).collect()} == want
    assert {r["seg_id"]: r["col"] for r in ordering.relax_by_rounds(cols, pairs, 20).collect()} == want
    assert {r["seg_id"]: r["col"] for r in ordering.relax(cols, pairs, 2).collect()} == {r["seg_id"]: r["col"] for r in ordering.relax_by_rounds(cols, pairs, 2).collect()}
    rng = random.Random(5)
    for graph in ([(0, 1), (1, 0)], [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4)], [(rng.randrange(6), rng.randrange(6)) for _ in range(9)]):
        pairs = spark.createDataFrame([p for p in graph if p[0] != p[1]], "u long, v long")  # cycles end alike
        one, two = ({r["seg_id"]: r["col"] for r in f(cols, pairs, 10).collect()} for f in (ordering.relax, ordering.relax_by_rounds))
        assert one == two


def test_wide_levels_and_ties():
    """Values and paths do not depend on how many edges are scored at a time."""
    rng = random.Random(8)
    for _ in range(6):
        g = expanded.HapGraph()
        rows = [[0]] + [list(range(1 + 7 * k, 8 + 7 * k)) for k in range(4)] + [[29]]
        for lv, row in enumerate(rows):
            for _x in row:
                g.level.append(lv)
                g.colors[g.node(0, [len(g.level)])] = sorted(rng.sample(range(9), rng.randint(0, 3)))
        for a, b in zip(rows, rows[1:], strict=False):
            for u in a:
                for v in b:
                    g.out[u].append((v, rng.randint(0, 1)))
        g.source, g.sink = 0, 29
        hom = [c % 2 == 0 for c in range(9)]
        for mode in ("as_coded", "cross_path"):
            got = [dp.diploid(g, 3, hom, mode, cells) for cells in (1, 50, 1 << 22)]
            assert got[0] == got[1] == got[2]


def test_mixture(spark):
    import numpy as np

    assert abs(mixture.zipf(2.0, 10).sum() - 1) < 1e-12
    hist = spark.createDataFrame([(x, int(1000 * np.exp(-((x - 10) ** 2) / 18)) + (400 if x == 1 else 0)) for x in range(1, 25)], "multiplicity long, freq long")
    f = mixture.fit(hist, {"u": 5, "sd": 3, "var": 2, "zp": 2, "zp_het": 2, "p_d": 3, "p_e": 2, "s": 2})
    top = float(hist.filter("freq > 0").agg({"multiplicity": "max"}).first()[0])
    axes = mixture.grid(top, {"u": 5, "sd": 3, "var": 2, "zp": 2, "zp_het": 2, "p_d": 3, "p_e": 2, "s": 2})
    rows = hist.collect()
    x, y = (np.array([float(r[c]) for r in rows]) for c in ("multiplicity", "freq"))
    every = []
    for idx in range(int(np.prod([len(a) for a in axes.values()]))):
        p = mixture.point(axes, idx)
        mix = p["p_e"] * mixture.error_pmf(x, p["s"]) + (1 - p["p_e"]) * (p["p_d"] * mixture.het(x, p["u"], p["var"], p["zp_het"]) + (1 - p["p_d"]) * mixture.hom(x, p["u"], p["sd"], p["zp"]))
        every.append(float(-(y * np.log(mix + 1e-300)).sum()))
    assert abs(f.nll - min(every)) < 1e-6
    with pytest.raises(ValueError):
        mixture.fit(hist.limit(0))
    assert mixture.valley_peak(hist) is not None and mixture.valley_peak(hist.filter("multiplicity < 2")) is None
    assert mixture.posterior(np.array([1]), f)[2][0]


def test_elbow_and_options():
    assert dp.elbow([5, 5, 5]) == 0 and dp.elbow([1, 10, 18, 18]) == 2 and dp.elbow([1, 2, 3]) == 0
    cfg, _ = parse(["-g", "a", "-r", "b", "-o", "c", "-p", "1", "-R", "4"])
    assert (cfg.k, cfg.w, cfg.recombinations, cfg.ploidy) == (31, 25, 4, 1)


def test_streaming_spectrum(spark, tmp_path):
    from strandweave.streaming.spectrum import stream_multiplicities

    schema = "read_id long, seq string"
    for i, s in enumerate([READ1, READ1, READ1[:12]]):
        spark.createDataFrame([(i, s)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    stream = stream_multiplicities(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 5, 3)
    q = stream.writeStream.format("memory").queryName("spectrum").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = minimizers.multiplicities(minimizers.extract_sets(spark.read.parquet(str(tmp_path / "in")), "read_id", "seq", 5, 3))
    assert sorted(spark.table("spectrum").collect()) == sorted(batch.collect())


def test_frames_agree_with_the_kernel(spark):
    paths = [[0, 1, 3], [0, 2, 3]]
    steps = spark.createDataFrame([(h, i, v) for h, p in enumerate(paths) for i, v in enumerate(p)], "walk_id long, pos int, seg_id long")
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3)], "u long, v long")
    g, _, _ = expanded.expand(paths, {0: [1, 2], 1: [3], 2: [3]}, [])
    assert frames.switches(steps, edges).count() == sum(w for *_, w in g.edges())
    assert frames.recombination_nodes(steps, edges).count() == sum(1 for h in g.hap if h == -1)


def test_frames_agree_with_the_programs(spark):
    """Elbow, colours of a path and certificate as frames and as the programs use them."""
    rng = random.Random(3)
    curves = {g: [rng.randint(0, 30) for _ in range(rng.randint(1, 7))] for g in range(40)}
    rows = spark.createDataFrame([(g, r, n) for g, c in curves.items() for r, n in enumerate(c)], "grp long, r int, distinct long")
    assert {r["grp"]: r["best"] for r in frames.elbows(rows).collect()} == {g: dp.elbow(c) for g, c in curves.items()}

    hom = [c % 2 == 0 for c in range(8)]
    pairs = {g: [[[rng.randrange(8) for _ in range(rng.randint(0, 3))] for _ in range(5)] for _ in range(2)] for g in range(30)}
    counted = {g: [dp.path_colours(path) for path in two] for g, two in pairs.items()}
    rows = spark.createDataFrame([(g, c, hom[c], one.get(c, 0), two.get(c, 0)) for g, (one, two) in counted.items() for c in {*one, *two}], "grp long, color int, hom boolean, k1 long, k2 long")
    for r in frames.certificates(rows).collect():
        want = dp.certificate(*counted[r["grp"]], hom, 0)
        assert (r["objective"], r["m_hom"], r["m_het"]) == (want["objective"], want["m_hom"], want["m_het"])
    rows = spark.createDataFrame([(g, c) for g, two in pairs.items() for own in two[0] for c in own], "path long, color int")
    got = {r["path"]: (r["colors"], r["ratio"]) for r in frames.colours_on_path(rows, "path", "color").collect()}
    assert got == {g: (len(c[0]), sum(c[0].values()) / len(c[0])) for g, c in counted.items() if c[0]}


def test_fasta_in_splits(spark, tmp_path):
    """Records that cross split borders come out whole, as from the whole file."""
    rng = random.Random(4)
    text = ""
    for i in range(300):
        seq = "".join(rng.choices("ACGTN", k=rng.randint(0, 200)))
        text += f">r{i} comment > {i}\n" + "".join(seq[k : k + 60] + rng.choice(["\n", "\r\n"]) for k in range(0, len(seq), 60))
    (tmp_path / "r.fa").write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    got = fasta.reads(spark, str(tmp_path / "r.fa"))
    assert got.rdd.getNumPartitions() > 5
    rows = [(r["name"], r["seq"]) for r in got.orderBy("read_id").collect()]
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows == list(fasta.records(text.splitlines()))
    with gzip.open(tmp_path / "z.fa.gz", "wt") as f:
        f.write(text)
    assert [(r["name"], r["seq"]) for r in fasta.reads(spark, str(tmp_path / "z.fa.gz")).orderBy("read_id").collect()] == rows


def test_written_graph_reads_back(spark, tmp_path):
    t = gfa.parse(spark.createDataFrame([(0, "S\ta\tACGT\tSN:Z:c\tSO:i:0\tSR:i:0"), (1, "S\tb\t*\tLN:i:7"), (2, "L\ta\t+\tb\t-\t3M"), (3, "L\ta\t+\tb\t+\t:5")], "line long, value string"))
    gfa.write_gfa(t.segments, t.links, str(tmp_path / "g"))
    again = gfa.read_gfa(spark, str(tmp_path / "g"))
    assert sorted(r["value"] for r in gfa.gfa_text(again.segments, again.links).collect()) == sorted(r["value"] for r in gfa.gfa_text(t.segments, t.links).collect())
    assert again.segments.count() == again.links.count() == 2


def test_diploid_fasta_folder(spark, tmp_path):
    rows = spark.createDataFrame([("sol_1", "ACGT" * 50), ("sol_2", "A")], "name string, seq string")
    fasta.write_fasta(rows, str(tmp_path / "out"), "bp")
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(x for x in lines if x[0] == ">") == [">sol_1 bp:200", ">sol_2 bp:1"] and max(map(len, lines)) == 80
    assert sorted((r["name"], r["seq"]) for r in fasta.read_fasta(spark, str(tmp_path / "out")).collect()) == sorted(map(tuple, rows.collect()))


def test_walks_know_earlier_segments_only(spark):
    lines = ["W\ts\t1\tc\t0\t9\t>a>b", "S\ta\tACGT", "L\ta\t+\tb\t+\t2M\tL1:i:9\tL2:i:3", "W\ts\t2\tc\t0\t9\t>a>b>x", "S\tx\tA"]
    t = gfa.parse(spark.createDataFrame(list(enumerate(lines)), "line long, value string"))
    segs = graph.encode_segments(t.segments, t.links)
    assert {r["name"]: r["len"] for r in segs.collect()} == {"a": 11, "b": 5, "x": 1}  # 2 + 9 and 2 + 3 from the link's tags
    names = {r["seg_id"]: r["name"] for r in segs.collect()}
    steps = graph.walk_table(t.walks.withColumn("walk_id", t.walks.hap), segs)
    assert sorted((r["walk_id"], r["pos"], names[r["seg_id"]]) for r in steps.collect()) == [(2, 0, "a"), (2, 1, "b")]


def test_options():
    cfg, args = parse("-g a -r b -o c -P 100 -q 1 -m 1 -H 15 -l 0 -N 0 -c 5000 -a 1 -t 8 -d 1 -T 0.5".split())
    assert (cfg.threshold, args.threads, args.debug) == (0.5, 8, 1)
    with pytest.raises(SystemExit):
        parse(["--version"])


def test_haplotype_folders(spark, tmp_path):
    fasta.write_haplotypes(spark.createDataFrame([("h_1", "ACGT" * 30), ("h_2", "T")], "name string, seq string"), str(tmp_path / "h"))
    got = {r["hap"]: r["seq"] for r in spark.read.option("basePath", str(tmp_path / "h")).text(str(tmp_path / "h")).groupBy("hap").agg({"value": "count"}).withColumnRenamed("count(value)", "seq").collect()}
    assert got == {"h_1": 3, "h_2": 2}
