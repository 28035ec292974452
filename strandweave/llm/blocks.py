"""All-pairs work inside groups, dealt in bounded blocks.

A group of any size is cut into blocks of at most about ``size`` members; every
unordered pair of blocks becomes one unit of work that holds the members of both
blocks. Pairs are compared inside the unit in Python and never leave it: a unit
returns one row for each member that has links, so no group is ever gathered in
one task and no pair list is emitted.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deal(members: DataFrame, keys: list[str], sizes: DataFrame, id_col: str, size: int) -> DataFrame:
    """Rows of ``members`` copied to their units of work.

    ``sizes`` has ``keys`` and ``n``, the member count of each group worth
    comparing. Adds ``_bi`` and ``_bj`` (the unit, ``_bi <= _bj``) and ``_mine``
    (the row's own block). A row of a group with ``b`` blocks gets ``b`` copies.
    """
    blocks = F.ceil(F.col("n") / size).cast("int")
    rows = (
        members.join(sizes.select(*keys, blocks.alias("_blocks")), keys)
        .withColumn("_mine", F.pmod(F.xxhash64(F.col(id_col)), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    )
    return rows.withColumns({"_bi": F.least("_mine", "_other"), "_bj": F.greatest("_mine", "_other")}).drop("_other", "_blocks")


def grouped(rows: DataFrame, joins: DataFrame, id_col: str) -> DataFrame:
    """(id, grp) of ``rows(id, grp)`` after ``joins(u, v)`` between groups."""
    from .common import connected_components

    comps = connected_components(joins.select("u", "v")).select(F.col("node").alias("grp"), "component")
    return rows.select(id_col, "grp").distinct().join(comps, "grp", "left").select(id_col, F.coalesce("component", "grp").alias("grp"))


def settle(nodes: DataFrame, links: DataFrame, key: str, id_col: str) -> DataFrame:
    """Join link counts and components back to all ``nodes``.

    ``links`` has ``key``, ``n`` (direct links found in one unit), and ``u`` and ``v``
    (ids of the node and of a member of its component). Adds ``n_direct`` and
    ``component``, the smallest id.
    """
    from .common import connected_components

    counts = links.groupBy(key).agg(F.sum("n").alias("n_direct"))
    comps = connected_components(links.select("u", "v"))
    return (
        nodes.join(counts, key, "left")
        .join(comps.withColumnRenamed("node", id_col), id_col, "left")
        .withColumn("n_direct", F.coalesce("n_direct", F.lit(0).cast("long")))
        .withColumn("component", F.coalesce("component", F.col(id_col)))
    )


def roots_of(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest member index reachable from each of ``n`` nodes through the pairs."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[left], low[right])
        new = low.copy()
        np.minimum.at(new, left, m)
        np.minimum.at(new, right, m)
        new = new[new]
        if (new == low).all():
            return low
        low = new
