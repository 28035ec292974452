"""Command line: ``python -m strandweave -g graph.gfa -r reads.fa -o out``."""

from __future__ import annotations

import resource
import sys
import time

from pyspark import SparkConf
from pyspark.sql import SparkSession

from .config import parse
from .plans.infer import run_files


def main() -> None:
    began = time.time()
    cfg, args = parse()
    builder = SparkSession.builder.appName("strandweave")
    if "spark.master" not in dict(SparkConf().getAll()):
        builder = builder.master(f"local[{args.threads}]")
    rows = run_files(builder.getOrCreate(), args.graph, args.reads, args.output, cfg)
    if args.debug:
        rows.explain("formatted")
    use = resource.getrusage(resource.RUSAGE_SELF)
    print(f"Real time: {time.time() - began:.3f} s; CPU of the driver's Python: {use.ru_utime + use.ru_stime:.3f} s; peak RSS: {use.ru_maxrss / 2**20:.3f} GB", file=sys.stderr)


if __name__ == "__main__":
    main()
