"""Mixture model of minimizer multiplicities: error, one-copy and two-copy curves.

Curves are evaluated once for the parameters they depend on and mixed for the
whole grid; the grid is dealt over (u, sd) to tasks that each return their best
point, and the smallest (negative log-likelihood, grid index) wins, which is the
first in nested order of equals.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NORMAL = 0.3989422804014327  # 1 / sqrt(2 pi)
FLOOR = 1e-300
# Bounds and steps of the grid, outermost first; u runs to the largest multiplicity.
BOUNDS = {
    "u": (1.0, None, 7),
    "sd": (0.5, 2.0, 7),
    "var": (0.71, 4.0, 5),
    "zp": (1.01, 4.0, 7),
    "zp_het": (1.01, 4.0, 7),
    "p_d": (0.1, 1.0, 7),
    "p_e": (0.0, 0.1, 5),
    "s": (1.01, 4.0, 5),
}


@dataclass(frozen=True)
class Fit:
    u: float
    sd: float
    var: float
    zp: float
    zp_het: float
    p_d: float
    p_e: float
    s: float
    nll: float = math.nan
    max_copy: int = 10


def zipf(exponent: float, copies: int) -> np.ndarray:
    """Weights of 1 .. copies, summing to one."""
    if exponent <= 1:
        raise ValueError("the exponent must exceed 1")
    w = np.arange(1, copies + 1, dtype=float) ** -exponent
    return w / w.sum()


def error_pmf(x: np.ndarray, s: float) -> np.ndarray:
    x = np.asarray(x, float)
    safe = np.maximum(x, 1)
    return np.where(x <= 0, 0.0, np.maximum(safe**-s - (safe + 1) ** -s, FLOOR))


def curve(x: np.ndarray, mean: float, sd: float, exponent: float, copies: int) -> np.ndarray:
    """Sum over copies c of zipf(c) * Normal(c * mean, sqrt(c) * sd)."""
    c = np.arange(1, copies + 1, dtype=float)
    width = np.maximum(np.sqrt(c) * sd, 1e-12)
    z = (np.asarray(x, float)[:, None] - c * mean) / width
    return np.maximum((zipf(exponent, copies) * NORMAL / width * np.exp(-0.5 * z * z)).sum(axis=1), FLOOR)


def hom(x, u: float, sd: float, zp: float, copies: int = 10) -> np.ndarray:
    return curve(x, u, sd, zp, copies)


def het(x, u: float, var: float, zp_het: float, copies: int = 10) -> np.ndarray:
    return curve(x, 0.5 * u, 0.5 * math.sqrt(max(var, 1e-12)), zp_het, copies)


def grid(u_hi: float, steps: dict[str, int] | None = None) -> dict[str, np.ndarray]:
    out = {}
    for name, (lo, hi, n) in BOUNDS.items():
        hi = u_hi if hi is None else hi
        n = (steps or {}).get(name, n)
        out[name] = np.array([lo]) if abs(hi - lo) < 1e-12 else np.array([(lo + hi) / 2]) if n <= 1 else lo + np.arange(n) / (n - 1) * (hi - lo)
    return out


def best_of(x: np.ndarray, y: np.ndarray, axes: dict[str, np.ndarray], pairs: Iterable[tuple[int, int]], copies: int = 10) -> tuple[float, int]:
    """Smallest (nll, grid index) over some (u, sd) index pairs."""
    sizes = [len(a) for a in axes.values()]
    inner = int(np.prod(sizes[2:]))
    errors = np.stack([error_pmf(x, s) for s in axes["s"]])
    best = (math.inf, -1)
    p_d, p_e = axes["p_d"], axes["p_e"]
    for iu, isd in pairs:
        u = axes["u"][iu]
        homs = np.stack([hom(x, u, axes["sd"][isd], z, copies) for z in axes["zp"]])
        for iv, var in enumerate(axes["var"]):
            hets = np.stack([het(x, u, var, z, copies) for z in axes["zp_het"]])
            # zp, zp_het, p_d, bin
            body = p_d[None, None, :, None] * hets[None, :, None] + (1 - p_d)[None, None, :, None] * homs[:, None, None]
            mix = p_e[None, :, None, None] * errors[None, None] + (1 - p_e)[None, :, None, None] * body.reshape(-1, 1, 1, len(x))
            nll = -(np.log(mix + FLOOR) @ y).ravel()
            at = int(nll.argmin())
            index = (iu * sizes[1] + isd) * inner + iv * (inner // sizes[2]) + at
            best = min(best, (float(nll[at]), index))
    return best


def point(axes: dict[str, np.ndarray], index: int) -> dict[str, float]:
    at = np.unravel_index(index, [len(a) for a in axes.values()])
    return {n: float(a[i]) for (n, a), i in zip(axes.items(), at, strict=True)}


def fit(hist: DataFrame, steps: dict[str, int] | None = None, copies: int = 10) -> Fit:
    """Grid fit of a histogram (multiplicity, freq).

    The histogram has one row for each distinct multiplicity and is read whole.
    """
    rows = sorted((r["multiplicity"], float(r["freq"])) for r in hist.filter("multiplicity >= 1 and freq > 0").collect())
    if not rows:
        raise ValueError("no minimizers: the histogram is empty")
    x, y = (np.array(c, float) for c in zip(*rows, strict=True))
    axes = grid(float(x.max()), steps)
    jobs = [(a, b) for a in range(len(axes["u"])) for b in range(len(axes["sd"]))]
    spark = hist.sparkSession

    def run(batches):
        for batch in batches:
            found = [best_of(x, y, axes, [(a, b)], copies) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int64())], ["nll", "idx"])

    dealt = spark.createDataFrame(jobs, "a int, b int").repartition(min(len(jobs), 49))
    best = dealt.mapInArrow(run, "nll double, idx long").agg(F.min(F.struct("nll", "idx")).alias("m")).first()["m"]
    return Fit(**point(axes, best["idx"]), nll=best["nll"], max_copy=copies)


def posterior(x: np.ndarray, f: Fit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(p_het, p_hom, is_het) for multiplicities; 1 is always HET."""
    x = np.asarray(x)
    a = f.p_e * error_pmf(x, f.s)
    b = (1 - f.p_e) * f.p_d * het(x, f.u, f.var, f.zp_het, f.max_copy)
    c = (1 - f.p_e) * (1 - f.p_d) * hom(x, f.u, f.sd, f.zp, f.max_copy)
    z = np.maximum(a + b + c, FLOOR)
    return b / z, c / z, (x == 1) | (b / z >= c / z)


def label(spectrum: DataFrame, f: Fit) -> DataFrame:
    """Spectrum with p_het, p_hom and label; each distinct multiplicity is classified once."""

    def run(batches):
        for batch in batches:
            p, q, h = posterior(batch.column(0).to_numpy(), f)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(q), pa.array(np.where(h, "HET", "HOM").tolist(), pa.string())], ["multiplicity", "p_het", "p_hom", "label"])

    once = spectrum.select("multiplicity").filter("multiplicity > 0").distinct().mapInArrow(run, "multiplicity long, p_het double, p_hom double, label string")
    return spectrum.join(once, "multiplicity")


def valley_peak(hist: DataFrame, width: int = 7) -> tuple[int, int] | None:
    """Valley and peak of the moving average over dense multiplicities; None under three bins."""
    rows = {r["multiplicity"]: float(r["freq"]) for r in hist.collect()}
    n = max(rows, default=0) + 1
    if n < 3:
        return None
    y = np.array([rows.get(i, 0.0) for i in range(n)])
    h = width // 2
    s = np.array([y[max(0, i - h) : i + h + 1].mean() for i in range(n)])
    valley = 2
    for i in range(2, min(n - 2, 50)):
        if s[i] < s[valley]:
            valley = i
        if i > 5 and s[i] > s[i - 1] > s[i - 2]:
            break
    span = s[valley + 1 : min(n - 1, 7 * valley + 6) + 1]
    return valley, valley + 1 + int(span.argmax()) if len(span) else valley


# The same curves as column expressions, for SQL-sized grids.


def zipf_column(exponent: Column, copy: Column, copies: int = 10) -> Column:
    total = sum((F.pow(F.lit(float(c)), -exponent) for c in range(1, copies + 1)), F.lit(0.0))
    return F.pow(copy.cast("double"), -exponent) / total


def curve_column(x: Column, mean: Column, sd: Column, exponent: Column, copies: int = 10) -> Column:
    out = F.lit(0.0)
    for c in range(1, copies + 1):
        width = F.greatest(sd * math.sqrt(c), F.lit(1e-12))
        z = (x - mean * float(c)) / width
        out = out + zipf_column(exponent, F.lit(c), copies) * F.lit(NORMAL) / width * F.exp(F.lit(-0.5) * z * z)
    return F.greatest(out, F.lit(FLOOR))


def error_column(x: Column, s: Column) -> Column:
    return F.when(x <= 0, 0.0).otherwise(F.greatest(F.pow(x, -s) - F.pow(x + 1, -s), F.lit(FLOOR)))


def mixture_column(x: Column, p: dict[str, Column], copies: int = 10) -> Column:
    hom_c = curve_column(x, p["u"], p["sd"], p["zp"], copies)
    het_c = curve_column(x, p["u"] * 0.5, F.sqrt(F.greatest(p["var"], F.lit(1e-12))) * 0.5, p["zp_het"], copies)
    return p["p_e"] * error_column(x, p["s"]) + (1 - p["p_e"]) * (p["p_d"] * het_c + (1 - p["p_d"]) * hom_c)


def nll_table(hist: DataFrame, points: DataFrame, copies: int = 10) -> DataFrame:
    """(idx, nll) of parameter rows; every row meets every bin of a small histogram."""
    names = list(BOUNDS)
    bins = F.transform(F.array_sort(F.collect_list(F.struct(F.col("multiplicity").cast("double").alias("x"), F.col("freq").cast("double").alias("y")))), lambda b: b)
    h = hist.filter("multiplicity >= 1 and freq > 0").agg(bins.alias("bins"))
    rows = points.crossJoin(F.broadcast(h)).select("idx", *names, F.explode("bins").alias("b"))
    mix = mixture_column(F.col("b.x"), {n: F.col(n) for n in names}, copies)
    return rows.select("idx", (-F.col("b.y") * F.log(mix + F.lit(FLOOR))).alias("t")).groupBy("idx").agg(F.sum("t").alias("nll"))


def moving_average(hist: DataFrame, width: int = 7) -> DataFrame:
    """Smoothed frequencies over the dense multiplicity axis, as a framed window.

    The histogram has one row for each distinct multiplicity; a single ordered
    window over it is small by construction.
    """
    h = width // 2
    top = hist.agg(F.max("multiplicity").alias("n"))
    dense = top.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))).alias("multiplicity")).join(hist, "multiplicity", "left")
    w = Window.orderBy("multiplicity").rowsBetween(-h, h)
    return dense.select("multiplicity", F.avg(F.coalesce("freq", F.lit(0)).cast("double")).over(w).alias("smooth"))


def as_row(f: Fit) -> dict:
    return asdict(f)
