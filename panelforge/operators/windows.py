"""Window primitives on time series and cross-sections, as column expressions.

Everything here that has an order is causal unless its name says forward. The
windows of one series share partition and order, so a select of many of them
has one exchange and one sort."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window, WindowSpec

from panelforge.functions.exprs import corr as pair_corr
from panelforge.functions.exprs import div, gate, roll, series, so_far


def delay(x: Column, n: int, w: WindowSpec | None = None) -> Column:
    return F.lag(x, n).over(w or series())


def lead(x: Column, n: int, w: WindowSpec | None = None) -> Column:
    return F.lead(x, n).over(w or series())


def delta(x: Column, n: int = 1, w: WindowSpec | None = None) -> Column:
    return x - delay(x, n, w)


def pct_change(x: Column, n: int = 1, w: WindowSpec | None = None) -> Column:
    """Change against the last known value n rows before (gaps are padded)."""
    p = F.last(x, True).over((w or series()).rowsBetween(Window.unboundedPreceding, -n))
    here = F.last(x, True).over((w or series()).rowsBetween(Window.unboundedPreceding, 0))
    return div(here, p) - 1


def mean(x, n, least=None):
    return gate(F.avg(x), x, roll(n), least or n)


def total(x, n, least=None):
    return gate(F.sum(x), x, roll(n), least or n)


def low(x, n, least=None):
    return gate(F.min(x), x, roll(n), least or n)


def high(x, n, least=None):
    return gate(F.max(x), x, roll(n), least or n)


def std(x, n, least=None):
    """Sample deviation; NULL for fewer than two values."""
    return gate(F.stddev_samp(x), x, roll(n), max(least or n, 2))


def median(x, n, least=None, w=None):
    return gate(F.percentile(x, 0.5), x, w or roll(n), least or n)


def _pairs(a: Column, b: Column) -> tuple[Column, Column]:
    return F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)


def corr(a, b, n, least=None):
    a, b = _pairs(a, b)
    return F.when(F.count(a).over(roll(n)) >= (least or max(5, n // 2)), pair_corr(a, b, roll(n)))


def cov(a, b, n, least=None):
    a, b = _pairs(a, b)
    return gate(F.covar_samp(a, b), a, roll(n), max(least or n, 2))


def rank_in(values: Column, x: Column) -> Column:
    """Average-tie percentile rank of x among an array's values."""
    below = F.size(F.filter(values, lambda v: v < x))
    same = F.size(F.filter(values, lambda v: v == x))
    return F.when(x.isNotNull(), (below + (same + 1) / 2) / F.size(values))


def ts_rank(x, n, least=None):
    """Rolling percentile rank; the list holds n values at most."""
    values = F.collect_list(x).over(roll(n))
    return F.when(F.count(x).over(roll(n)) >= (least or max(3, n // 2)), rank_in(values, x))


def argmax(x, n):
    """Place of the first greatest value in the last n, oldest first."""
    values = F.collect_list(x).over(roll(n))
    return F.when(F.count(x).over(roll(n)) >= n, F.array_position(values, F.array_max(values)) - 1)


def slope(y: Column, n: int, least: int | None = None) -> Column:
    """Least-squares slope against the row number. `least` rows are asked for
    (n: full windows only); a NULL inside leaves a gap in the window."""
    i = F.row_number().over(series()).cast("double")
    x = F.when(y.isNotNull(), i)
    return gate(F.regr_slope(y, x), y, roll(n), max(least or n, 2))


def zscore(x, n, least=None):
    least = least or max(10, n // 4)
    s = std(x, n, least)
    return div(x - mean(x, n, least), s)


def with_streak(df: DataFrame, cond: Column, name: str) -> DataFrame:
    """Adds how many rows in a row cond has held (0 where it doesn't)."""
    d = df.withColumn("_c", F.coalesce(cond, F.lit(False))).withColumn("_n", F.row_number().over(series()))
    last = F.max(F.when(~F.col("_c"), F.col("_n"))).over(so_far("symbol"))
    return d.withColumn(name, (F.col("_n") - F.coalesce(last, F.lit(0))).cast("int")).drop("_c", "_n")


def with_since(df: DataFrame, cond: Column, name: str) -> DataFrame:
    """Adds the rows since cond last held; 0 before it ever did."""
    d = df.withColumn("_c", F.coalesce(cond, F.lit(False))).withColumn("_n", F.row_number().over(series()))
    last = F.max(F.when(F.col("_c"), F.col("_n"))).over(so_far("symbol"))
    return d.withColumn(name, F.coalesce(F.col("_n") - last, F.lit(0)).cast("int")).drop("_c", "_n")


def forward_high(x, n):
    return F.max(x).over(series().rowsBetween(1, n))


def forward_low(x, n):
    return F.min(x).over(series().rowsBetween(1, n))


# --- cross-sections ----------------------------------------------------------

def xs_rank(x: Column, *keys: str, pct: bool = True) -> Column:
    """Average-tie rank of x within the keys, NULLs apart; as a share of the
    values that are not NULL, or plain."""
    w = Window.partitionBy(*keys)
    r = F.rank().over(w.orderBy(x.asc_nulls_last())) + (F.count(x).over(Window.partitionBy(*keys, x)) - 1) / 2
    return F.when(x.isNotNull(), r / F.count(x).over(w) if pct else r)


def xs_zscore(x: Column, *keys: str) -> Column:
    """0 where the cross-section doesn't vary."""
    w = Window.partitionBy(*keys)
    s = F.stddev_samp(x).over(w)
    return F.when(x.isNotNull(), F.coalesce(div(x - F.avg(x).over(w), s), F.lit(0.0)))


def xs_floor(x: Column, q: float, *keys: str) -> Column:
    """x, but the cross-section's q quantile at least."""
    return F.when(x.isNotNull(), F.greatest(x, F.percentile(x, q).over(Window.partitionBy(*keys))))


def whole_rank(x: Column) -> Column:
    """Rank within a symbol's whole history. Looks ahead: a leak, for tests."""
    return xs_rank(x, "symbol")


def whole_scale(x: Column) -> Column:
    """x over the sum of its absolute values. Looks ahead, too."""
    return div(x, F.sum(F.abs(x)).over(Window.partitionBy("symbol")))


def prefix_std(df: DataFrame, x: str, n: int, name: str, least: int | None = None) -> DataFrame:
    """Rolling deviation for wide windows by differences of running sums: one
    pass instead of n values a row. x is centred on the symbol's first value to
    limit cancellation."""
    w = so_far("symbol")
    d = df.withColumn("_x", F.col(x) - F.first(x, True).over(w))
    run = {"_s": F.sum("_x"), "_q": F.sum(F.col("_x") * F.col("_x")), "_k": F.count("_x")}
    d = d.withColumns({k: F.coalesce(a.over(w), F.lit(0)) for k, a in run.items()})
    s, q, k = (F.col(c) - F.coalesce(F.lag(c, n).over(series()), F.lit(0)) for c in run)
    var = div(q - s * s / k, k - 1)
    return d.withColumn(name, F.when(k >= max(least or n, 2), F.sqrt(F.greatest(var, F.lit(0.0))))).drop("_x", *run)


# --- recursion: one grouped kernel for all such columns ----------------------

def grouped(df: DataFrame, names: list[str], need: list[str], kernel, symbol: str = "symbol", ts: str = "ts") -> DataFrame:
    """df with double columns that a kernel makes of a symbol's rows in time
    order. Rows go through the one grouped call and come back with the columns
    put on: one exchange, nothing is joined and df is computed once. The kernel
    gets the needed columns as doubles (NULL is NaN) and returns the new ones by
    name; NaN becomes NULL."""
    fields = [StructField(f.name, f.dataType) for f in df.schema if f.name not in names]
    schema = StructType([*fields, *[StructField(k, DoubleType()) for k in names]])

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, [(ts, "ascending")])).select([f.name for f in fields])
        made = kernel(pd.DataFrame({k: t[k].cast(pa.float64()).to_numpy() for k in need}))
        for k in names:
            t = t.append_column(k, pa.array(np.asarray(made[k], dtype="float64"), from_pandas=True))
        return t

    return df.groupBy(symbol).applyInArrow(run, schema)


def recursive(df: DataFrame, specs: dict[str, tuple], symbol: str = "symbol", ts: str = "ts") -> DataFrame:
    """df with columns that need the row before them. specs: name ->
    ("ewm", column, alpha, least values), ("rank", column, least values), the
    expanding average-tie percentile rank, or a rolling ("total" | "mean" |
    "ts_rank", column, rows, least values), for wide windows, in which the
    built-in frames cost many times as much. All columns of a symbol in one
    grouped call; a group is one symbol's history."""
    def kernel(p: pd.DataFrame) -> dict:
        out = {}
        for name, spec in specs.items():
            x = p[spec[1]]
            if spec[0] == "ewm":
                out[name] = x.ewm(alpha=spec[2], adjust=False, min_periods=spec[3]).mean()
            elif spec[0] in ("total", "mean", "ts_rank"):
                out[name] = rolled(x.to_numpy(), *spec[2:], spec[0])
            else:
                out[name] = expanding_rank(x.to_numpy(), spec[2])
        return out

    return grouped(df, list(specs), sorted({s[1] for s in specs.values()}), kernel, symbol, ts)


#: Rows whose windows rolled() has open at once.
ROLL_BLOCK = 1024


def rolled(x: np.ndarray, n: int, least: int, kind: str) -> np.ndarray:
    """Total, mean or percentile rank over the last n rows, of known values."""
    far, out = np.concatenate([np.full(n - 1, np.nan), x]), np.full(len(x), np.nan)
    for a in range(0, len(x), ROLL_BLOCK):
        here = x[a:a + ROLL_BLOCK]
        v = np.lib.stride_tricks.sliding_window_view(far[a:a + len(here) + n - 1], n)
        known = v == v
        k = known.sum(1)
        with np.errstate(invalid="ignore", divide="ignore"):
            if kind == "ts_rank":
                y = ((v < here[:, None]).sum(1) + ((v == here[:, None]).sum(1) + 1) / 2) / k
                y[here != here] = np.nan
            else:
                y = np.where(known, v, 0.0).sum(1)
                y = y / k if kind == "mean" else y
        out[a:a + ROLL_BLOCK] = np.where(k >= least, y, np.nan)
    return out


#: Values that expanding_rank() compares with one another at once.
RANK_BLOCK = 256


def expanding_rank(x: np.ndarray, least: int) -> np.ndarray:
    """Average-tie percentile rank of each value among those so far: by search in
    the sorted values of the blocks before, by comparison within its block."""
    ok = np.flatnonzero(~np.isnan(x))
    v, out, past = x[ok], np.full(len(x), np.nan), np.empty(0)
    for a in range(0, len(v), RANK_BLOCK):
        b = v[a:a + RANK_BLOCK]
        lo, hi = np.searchsorted(past, b, "left"), np.searchsorted(past, b, "right")
        earlier = np.tri(len(b), dtype=bool)
        below = lo + ((b[None, :] < b[:, None]) & earlier).sum(1)
        same = hi - lo + ((b[None, :] == b[:, None]) & earlier).sum(1)
        out[ok[a:a + RANK_BLOCK]] = (below + (same + 1) / 2) / np.arange(a + 1, a + len(b) + 1)
        past = np.sort(np.concatenate([past, b]), kind="stable")
    out[ok[:least - 1]] = np.nan
    return out


def span(n: int) -> float:
    """alpha of an exponential mean over a span of n."""
    return 2.0 / (n + 1)


def add_all(df: DataFrame, parts: list[DataFrame], on: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, on, "left"), parts, df)
