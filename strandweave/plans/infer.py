"""Haplotype inference end to end: a graph and reads to one or two sequences.

Relational stages are DataFrames. The haplotype graph and its dynamic program
run in one task for each sample, so samples run side by side.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators import anchors as anc
from ..operators import dp, expanded, graph, minimizers, mixture, ordering
from ..operators.ids import dense_ids
from ..sources import fasta, gfa


class Pangenome:
    """Normalised graph tables, ready for any number of read sets."""

    def __init__(self, tables: gfa.GfaTables):
        self.segments = graph.encode_segments(tables.segments, tables.links)
        self.arcs = graph.normalise(graph.arcs_of(tables.links, self.segments), self.segments)
        self.walks = dense_ids(tables.walks, ["line"], "walk_id")
        self.steps = graph.flip_walks(graph.walk_table(self.walks, graph.defined(self.segments)))
        if not graph.reverse_walks(self.steps).isEmpty():
            raise ValueError("a walk holds reverse steps after flipping")
        if not graph.defined(self.segments).filter("seq is null").isEmpty():
            raise ValueError("a segment has a length but no sequence")
        self.edges = graph.forward_edges(self.arcs)
        self.columns = ordering.dense_columns(ordering.relax(ordering.seed_columns(self.steps, graph.defined(self.segments)), ordering.consecutive(self.steps)))
        self.haplotypes = anc.haplotype_sequences(self.steps, self.segments)

    def anchors(self, reads: DataFrame, cfg: EngineConfig) -> tuple[DataFrame, DataFrame]:
        """(anchors with labels, labelled spectrum); reads have (read_id, seq)."""
        found = minimizers.extract(self.haplotypes, "walk_id", "seq", cfg.k, cfg.w, cfg.hash_order)
        spectrum = minimizers.multiplicities(minimizers.extract_sets(reads, "read_id", "seq", cfg.k, cfg.w, cfg.hash_order), cfg.k, cfg.hash_order)
        spectrum = anc.minimizer_ids(spectrum) if cfg.hash_order == "lex" else dense_ids(spectrum, ["key"], "mid")
        spectrum = spectrum.select("key", "multiplicity", "mid")
        hits = anc.match(found, spectrum.select("key", "multiplicity"))
        placed = anc.with_vertices(hits.select("walk_id", "pos", "key"), anc.offsets(self.steps, self.segments), self.columns, cfg.k)
        walks = self.walks.count()
        kept = anc.drop_ubiquitous(placed, walks, cfg.threshold)
        hist = minimizers.histogram(spectrum)
        model = mixture.fit(hist, copies=cfg.max_copy)
        labelled = mixture.label(spectrum, model)
        return kept.join(labelled.select("key", "mid", "label"), "key"), labelled


def solve(sample: str, paths: list[list[int]], adjacency: dict[int, list[int]], anchors: list[tuple[int, int, list[int]]], hom_of: dict[int, bool], seqs: dict[int, str], cfg: EngineConfig) -> list[dict]:
    """Result rows of one sample."""
    g, spans, keys = expanded.expand(paths, adjacency, anchors)
    g = expanded.topological(g)
    hom = [hom_of.get(k, False) for k in keys]
    text = lambda vs: "".join(seqs[v] for v in vs)
    if cfg.ploidy == 1:
        got = dp.haploid(g, cfg.recombinations)
        return [{"sample": sample, "name": "dp_sol", "seq": text(got.path), "recombinations": got.best_r, "score": got.value[got.best_r], "objective": got.distinct[got.best_r], "factor": got.ratio[got.best_r]}]
    g = expanded.levelize(g)
    got = dp.diploid(g, cfg.recombinations, hom, cfg.score_mode)
    if not got.paths[0]:
        return []
    starts = {h: p[0] for h, p in enumerate(paths) if p}
    parts = [dp.recover(g, p, starts) for p in got.paths]
    inside = [dp.colours_inside(spans, s) for s in parts]
    cert = dp.certificate(*inside, hom, got.s_het)
    return [
        {"sample": sample, "name": f"sol_{k + 1}", "seq": text([v for s in part for v in dp.stretch(paths[s.hap], s)]), "recombinations": len(part) - 1, "score": got.value[-1], "objective": cert["objective"], "factor": cert["factor"]}
        for k, part in enumerate(parts)
    ]


RESULT = "sample string, name string, seq string, recombinations int, score long, objective long, factor double"


def infer(pan: Pangenome, reads: DataFrame, cfg: EngineConfig, sample: str = "sample") -> DataFrame:
    """One or two rows (sample, name, seq, ...) for a read set."""
    anchors, _ = pan.anchors(reads, cfg)
    pack = lambda df, kind, *cols: df.select(F.lit(sample).alias("sample"), F.lit(kind).alias("kind"), *cols)
    none_i, none_a, none_s = F.lit(None).cast("long"), F.lit(None).cast("array<long>"), F.lit(None).cast("string")
    rows = (
        pack(pan.steps, "step", F.col("walk_id").alias("a"), F.col("pos").cast("long").alias("b"), F.array(F.col("seg_id").cast("long")).alias("c"), none_s.alias("d"))
        .union(pack(ordering.sorted_adjacency(pan.edges, pan.columns), "edge", F.col("u"), none_i, F.transform("out", lambda x: x.cast("long")), none_s))
        .union(pack(anchors, "anchor", F.col("walk_id"), F.col("mid"), F.transform("vtxs", lambda x: x.cast("long")), F.col("label")))
        .union(pack(graph.defined(pan.segments), "segment", F.col("seg_id"), none_i, none_a, F.col("seq")))
    )

    def run(part: pa.Table) -> pa.Table:
        walks: dict[int, list] = {}
        adjacency, hits, hom, seqs, name = {}, [], {}, {}, None
        for r in part.to_pylist():
            name = r["sample"]
            if r["kind"] == "step":
                walks.setdefault(r["a"], []).append((r["b"], r["c"][0]))
            elif r["kind"] == "edge":
                adjacency[r["a"]] = r["c"]
            elif r["kind"] == "segment":
                seqs[r["a"]] = r["d"]
            else:
                hits.append((r["b"], r["a"], r["c"]))
                hom[r["b"]] = r["d"] == "HOM"
        paths = [[v for _, v in sorted(walks.get(h, []))] for h in range(max(walks, default=-1) + 1)]
        found = solve(name, paths, adjacency, sorted(hits), hom, seqs, cfg)
        return pa.Table.from_pylist(found, schema=pa.schema([("sample", pa.string()), ("name", pa.string()), ("seq", pa.string()), ("recombinations", pa.int32()), ("score", pa.int64()), ("objective", pa.int64()), ("factor", pa.float64())]))

    return rows.groupBy("sample").applyInArrow(run, RESULT)


def infer_batch(pan: Pangenome, read_sets: dict[str, DataFrame], cfg: EngineConfig) -> DataFrame:
    """Results of several samples; their tasks run side by side."""
    out = None
    for name, reads in read_sets.items():
        one = infer(pan, reads, cfg, name)
        out = one if out is None else out.union(one)
    return out


def run_files(spark: SparkSession, graph_path: str, reads_path: str, out_path: str, cfg: EngineConfig) -> DataFrame:
    """GFA and FASTA/FASTQ files to a FASTA folder."""
    pan = Pangenome(gfa.read_gfa(spark, graph_path))
    rows = infer(pan, fasta.reads(spark, reads_path), cfg)
    fasta.write_fasta(rows, out_path, "LN" if cfg.ploidy == 1 else "bp")
    return rows
