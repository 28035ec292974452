"""Read spectrum over a stream: multiplicities grow as read files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.minimizers import extract_sets, multiplicities


def stream_multiplicities(reads: DataFrame, k: int, w: int) -> DataFrame:
    """(key, multiplicity) of a streaming (read_id, seq) frame, for update or complete mode.

    A read is whole in one row, so its keys are made distinct inside the row and
    the state holds one counter for each key.
    """
    return multiplicities(extract_sets(reads, "read_id", "seq", k, w))
