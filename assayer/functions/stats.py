"""Scalar statistics as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def mean0(c: Column) -> Column:
    """Mean of the known values; 0 without any."""
    return F.coalesce(F.avg(F.nanvl(c.cast("double"), F.lit(None).cast("double"))), F.lit(0.0))


def stdev0(c: Column) -> Column:
    """Sample standard deviation; 0 for fewer than two values."""
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def safe_ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(F.lit(1), b)


def corr(x: Column, y: Column) -> Column:
    """Pearson over pairs; null for fewer than two pairs or without variance (where Spark's corr would raise)."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def sigma_of(score: Column, points: list[tuple[float, float]] | None = None) -> Column:
    """Standard deviation at a score: between the calibration's points a straight line, outside the nearest point."""
    pts = P.CALIBRATION if points is None else points
    s = score.cast("double")
    out = F.when(s <= pts[0][0], F.lit(pts[0][1]))
    for (x0, y0), (x1, y1) in zip(pts, pts[1:], strict=False):
        out = out.when(s <= x1, y0 + (s - x0) / (x1 - x0) * (y1 - y0))
    return F.when(s.isNotNull(), out.otherwise(F.lit(pts[-1][1])))


def confident_cleaner(clean: Column, dirty: Column, n_sigma: float = 3.0) -> Column:
    """Whether bands of n_sigma around the two scores don't meet."""
    gap = clean - dirty
    return F.coalesce((gap > 0) & (gap > n_sigma * (sigma_of(clean) + sigma_of(dirty))), F.lit(False))


def eval_se(n: Column, k: Column, between: float = P.SIGMA_BETWEEN, judge: float = P.SIGMA_JUDGE) -> Column:
    """Standard error of a mean over n items with k votes each."""
    total = F.sqrt(F.lit(between**2) + F.lit(judge**2) / F.greatest(F.lit(1), k))
    return total / F.sqrt(F.greatest(F.lit(1), n))


def mcnemar(b: Column, c: Column) -> Column:
    """Chi square with continuity correction from the two discordant counts; 0 without any."""
    n = b + c
    return F.when(n == 0, F.lit(0.0)).otherwise(F.pow(F.abs(b - c) - 1, 2) / F.greatest(F.lit(1), n))


def cost(tokens_in: Column, tokens_out: Column, price_in: float = P.PRICE_IN, price_out: float = P.PRICE_OUT) -> Column:
    return tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out


def half_open_bin(c: Column, edges: list[float]) -> Column:
    """Index of the bin [edge, next edge); null outside. A last edge just above 1 keeps 1 in."""
    out = F.lit(None).cast("int")
    for i, (lo, hi) in reversed(list(enumerate(zip(edges, edges[1:], strict=False)))):
        out = F.when((c >= lo) & (c < hi), F.lit(i)).otherwise(out)
    return out
