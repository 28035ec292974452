"""Sequence expressions: complements, k-mers, wrapping, path strings."""

from __future__ import annotations

import string

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .murmur import murmur64, murmur64_of

# IUPAC codes and their complements, case kept.
IUPAC = "ACGTRYSWKMBDHVNacgtryswkmbdhvn"
IUPAC_COMPLEMENT = "TGCAYRSWMKVHDBNtgcayrswmkvhdbn"


def upper_ascii(s: Column) -> Column:
    return F.translate(s, string.ascii_lowercase, string.ascii_uppercase)


def revcomp(s: Column) -> Column:
    """Reverse complement; ACGT come out in upper case, other characters as they are."""
    return F.reverse(F.translate(s, "ACGTacgt", "TGCATGCA"))


def revcomp_iupac(s: Column) -> Column:
    return F.reverse(F.translate(s, IUPAC, IUPAC_COMPLEMENT))


def canonical(kmer: Column) -> Column:
    return F.least(kmer, revcomp(kmer))


def wrap(s: Column, width: int = 80) -> Column:
    """Lines of at most ``width`` characters."""
    return F.regexp_extract_all(s, F.lit(f"(.{{1,{width}}})"), F.lit(1))


def joined(pos: Column, seq: Column) -> Column:
    """Aggregate: sequences along a path, in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos.alias("p"), seq.alias("s")))), lambda x: x["s"]), "")


def anchor_key(vertices: Column) -> Column:
    """Vertices of an anchor as ``v1_v2_..._``."""
    return F.array_join(F.transform(vertices, lambda v: F.concat(v.cast("string"), F.lit("_"))), "")


def haplotype_name(graph: Column, reads: Column) -> Column:
    base = lambda p: F.regexp_replace(F.regexp_replace(p, r"^.*/", ""), r"\.[^.]*$", "")
    return F.concat_ws("_", base(graph), base(reads))


@F.pandas_udf(T.LongType())
def murmur(s: pd.Series) -> pd.Series:
    """Folded murmur of a string's bytes, as the signed view of 64 unsigned bits."""
    out = pd.Series(pd.NA, index=s.index, dtype="Int64")
    sizes = s.dropna().str.len()
    for size in sizes.unique():
        at = sizes.index[sizes == size]
        data = [x.encode() for x in s[at]]
        if all(len(x) == size for x in data):
            out[at] = murmur64(np.frombuffer(b"".join(data), np.uint8).reshape(len(data), -1)).view(np.int64)
        else:
            out[at] = [int(np.uint64(murmur64_of(x)).view(np.int64)) for x in data]
    return out


def unsigned_order(h: Column) -> Column:
    """Sort key that puts signed views of unsigned 64-bit values in unsigned order."""
    return h.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
