"""Dense global ids without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def dense_ids(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Number rows ``start ..`` in the order of ``order``, which must be a key.

    Rows are range-partitioned, sorted and kept in the shared folder, so that
    places do not move between the count and its use; only one count for each
    partition reaches the driver.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = placed.withColumn("_at", F.monotonically_increasing_id())
    placed = cut(placed)
    part = F.call_function("shiftright", F.col("_at"), F.lit(33))
    counts = placed.groupBy(part.alias("p")).count().collect()
    base, total = [], start
    for r in sorted(counts):
        base.append((r["p"], total))
        total += r["count"]
    first = df.sparkSession.createDataFrame(base, "_p long, _first long")  # a row a partition: small enough to broadcast
    out = placed.join(F.broadcast(first), part == F.col("_p")).withColumn(name, (F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long"))
    return out.drop("_at", "_p", "_first")
