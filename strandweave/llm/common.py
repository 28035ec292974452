"""Shared pieces of the training-data operators.

Nothing here is specific to one operator: table access, lineage cuts in the
shared folder, connected components and a way to bind a column expression once
inside higher-order functions.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space of the word contracts: space and U+0009 .. U+000D.
WS = " \t\n\x0b\x0c\r"
WS_SPLIT = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_scratch: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        path = tempfile.mkdtemp(prefix="strandweave-")  # driver and executors are one process
    if not path:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for a table that ``sweep`` removes."""
    _scratch.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _scratch[-1]


def forget(path: str) -> None:
    """Keep a folder of ``scratch`` when the others are swept."""
    _scratch.remove(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def swept_from() -> int:
    """A mark for ``sweep``: later tables only."""
    return len(_scratch)


def sweep(spark: SparkSession, mark: int = 0) -> None:
    """Remove the tables of ``scratch`` since ``mark``; frames that read them must have been used up."""
    while len(_scratch) > mark:
        remove_folder(spark, _scratch.pop())


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of each action inside go when it ends, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably in the shared folder and drop its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """``body(x)`` with ``x`` bound to ``value``, evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lookup(rows: DataFrame, table: DataFrame, key: str, count: str, spread: str, total: int | None = None, outer: bool = False, share: int = 1000) -> DataFrame:
    """``rows`` joined with ``table``, which has one row a key and the number of rows of each in ``count``.

    Keys with at least a ``share``-th of all rows, of which there are at most
    ``share``, are broadcast, so that no task gets a hot key's rows; ``spread``
    deals those rows evenly while the others are joined by key. ``total`` is the
    number of rows if it is known; ``outer`` keeps rows without a partner.
    """
    values = [c for c in table.columns if c not in (key, count)]
    if total is None:
        marked = table.crossJoin(F.broadcast(table.agg(F.sum(count).alias("_all")))).withColumn("_hot", F.col(count) * share >= F.col("_all"))
    else:
        marked = table.withColumn("_hot", F.col(count) * share >= F.lit(total))
    hot = marked.filter("_hot").select(key, F.struct(*values, "_hot").alias("_h"))
    zero = F.pmod(F.col(count), F.lit(1)).cast("long")  # a literal would drop out of the join's keys, and the salt with it
    rest = marked.filter("not _hot").select(key, zero.alias("_salt"), F.struct(*values, "_hot").alias("_r"))
    salted = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.when(F.col("_h").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(1 << 20))).cast("long"))
    both = salted.join(rest, [key, "_salt"], "left").withColumn("_v", F.coalesce("_h", "_r"))
    both = both if outer else both.filter("_v is not null")
    return both.select(*rows.columns, *[F.col(f"_v.{c}").alias(c) for c in values])


FEW_EDGES = 20_000  # below this all edges of a node may meet in one task


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id for every node of ``edges(u, v)``, undirected.

    Alternating large-star and small-star contraction; every round is two
    aggregations and two joins over edges, cut in the shared folder, and edges
    only shrink. A star's root may have a third of all edges: nodes with many are
    looked up by broadcast, the others by join. Returns ``(node, component)`` for
    all nodes that have an edge to another node.
    """
    e = (
        edges.filter(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    e = cut(e)
    seen = None
    for _ in range(max_rounds):
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark

        def least(of: DataFrame, total: int) -> DataFrame:
            low = of.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
            return of.join(low.drop("c"), "u") if total < FEW_EDGES else lookup(of, low, "u", "c", "v", total)

        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least(both, 2 * mark[0]).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = least(large, mark[0])
        e = cut(
            small.select("u", F.col("m").alias("v"))
            .union(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
            .filter("u <> v")
            .distinct()
        )
    else:
        raise RuntimeError("connected components did not settle")
    star = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return star.union(roots)
