"""Engine options and the command line."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields


VERSION = "0.2"


@dataclass(frozen=True)
class EngineConfig:
    """Options of one inference run; names follow the command line's letters."""

    k: int = 31  # k-mer length
    w: int = 25  # window of k-mers
    recombinations: int = 18  # budget R, shared by both paths of a diploid run
    ploidy: int = 2
    threshold: float = 1.0  # T: a minimizer on one path in T * walks occurrences is dropped
    max_copy: int = 10
    score_mode: str = "as_coded"  # or cross_path
    hash_order: str = "lex"  # k-mers compare as bytes; or murmur

    def __post_init__(self) -> None:
        if self.ploidy not in (1, 2):
            raise ValueError("ploidy is 1 or 2")
        if self.k < 1 or self.w < 1 or self.recombinations < 0:
            raise ValueError("k and w are positive, R is not negative")


def parse(argv: list[str] | None = None) -> tuple[EngineConfig, argparse.Namespace]:
    p = argparse.ArgumentParser(prog="strandweave", description="Infer one or two haplotypes from a pangenome graph and reads.")
    p.add_argument("-g", "--graph", required=True, help="GFA file, optionally gzipped")
    p.add_argument("-r", "--reads", required=True, help="FASTA or FASTQ file")
    p.add_argument("-o", "--output", required=True, help="folder for the FASTA result")
    p.add_argument("-k", type=int, default=31)
    p.add_argument("-w", type=int, default=25)
    p.add_argument("-R", dest="recombinations", type=int, default=18)
    p.add_argument("-p", dest="ploidy", type=int, default=2)
    p.add_argument("-T", dest="threshold", type=float, default=1.0)
    p.add_argument("-t", dest="threads", type=int, default=4, help="threads of a local run without a configured master")
    p.add_argument("-d", dest="debug", type=int, default=0, help="1: print the plan")
    p.add_argument("-a", dest="approximator", type=int, default=0, help="accepted; the dynamic programs are the only solver")
    for name, what in {"P": "recombination penalty", "q": "quadratic or linear form", "m": "mixed or integer form", "H": "top haplotypes", "l": "coverage mode", "N": "expanded graph form", "c": "most occurrences"}.items():
        p.add_argument(f"-{name}", type=int, help=f"accepted without effect: {what} of the integer program")
    p.add_argument("--version", action="version", version=VERSION)
    args = p.parse_args(argv)
    names = {f.name for f in fields(EngineConfig)}
    return EngineConfig(**{k: v for k, v in vars(args).items() if k in names}), args
