"""Null-safe column expressions: inside the library missing is NULL, never NaN
or infinite, and a flag is never NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def series(symbol: str = "symbol", ts: str = "ts") -> WindowSpec:
    """One time series per symbol, in time order."""
    return Window.partitionBy(symbol).orderBy(ts)


def roll(n: int, symbol: str = "symbol", ts: str = "ts") -> WindowSpec:
    """The last n rows, this one included."""
    return series(symbol, ts).rowsBetween(-(n - 1), 0)


def so_far(*keys: str, ts: str = "ts") -> WindowSpec:
    """All rows of the keys up to this one."""
    return Window.partitionBy(*keys).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)


def cross(*keys: str) -> WindowSpec:
    """A cross-section: all rows of the keys."""
    return Window.partitionBy(*keys)


def num(c: Column) -> Column:
    """Bad, NaN or infinite values become NULL."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def div(a: Column, b: Column) -> Column:
    """NULL where the divisor is 0 or NULL."""
    return F.try_divide(a, b)


def flag(c: Column) -> Column:
    """1 where true, 0 where false or NULL."""
    return F.coalesce(c.cast("int"), F.lit(0))


def gate(agg: Column, x: Column, w: WindowSpec, least: int) -> Column:
    """agg over the window once `least` values of x are not NULL in it."""
    return F.when(F.count(x).over(w) >= least, agg.over(w))


def clip(x: Column, lo: float, hi: float) -> Column:
    """x within [lo, hi]; NULL stays NULL."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x)))


def sign(x: Column) -> Column:
    return F.signum(x)


def corr(a: Column, b: Column, w: WindowSpec | None = None) -> Column:
    """Correlation, as an aggregate or over a window, of rows where both are
    known; NULL where one doesn't vary (the built-in raises in ANSI mode)."""
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    parts = (F.covar_pop(a, b), F.stddev_pop(a), F.stddev_pop(b))
    c, x, y = (p.over(w) for p in parts) if w is not None else parts
    return F.try_divide(c, x * y)
