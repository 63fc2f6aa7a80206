"""Scalars of statistics that Spark has no function for, for results that are
one row per feature or strategy; on columns where rows may be many."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

_N = NormalDist()


def norm_ppf(p: float) -> float:
    """Standard normal quantile; infinite at 0 and 1."""
    if not 0 < p < 1:
        return math.copysign(math.inf, p - 0.5) if p in (0, 1) else math.nan
    return _N.inv_cdf(p)


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def two_sided_p(t: float) -> float:
    return math.erfc(abs(t) / math.sqrt(2)) if math.isfinite(t) else math.nan


def expected_max_t(n: int) -> float:
    """About the largest t of n unrelated features without any effect."""
    if n < 2:
        return 0.0
    euler = 0.5772156649015329
    return (1 - euler) * norm_ppf(1 - 1 / n) + euler * norm_ppf(1 - 1 / (n * math.e))


def cdf(x: Column) -> Column:
    """Normal distribution function as an expression: a fifth-degree polynomial
    in 1 / (1 + 0.2316419 |x|), error below 8e-8."""
    # Fixed values of the approximation.
    a = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = F.lit(0.0)
    for k in reversed(a):
        poly = t * (F.lit(k) + poly)
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def probabilistic_sharpe(sr: Column, benchmark: Column, n: Column, skew: Column, kurt: Column) -> Column:
    """Probability that the true Sharpe ratio is over the benchmark; kurt is the
    plain kurtosis (3 for a normal)."""
    var = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    return F.when((n > 1) & (var > 0), cdf((sr - benchmark) * F.sqrt(n - 1) / F.sqrt(var)))
