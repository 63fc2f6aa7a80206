"""The candidate factory: 14 transforms of each base column, and the formula
alphas of the factory that the daily set doesn't have. Every column is causal."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.functions.exprs import div, so_far
from panelforge.operators import daily
from panelforge.operators import windows as w

C = F.col

#: Rows back, window lengths, and steps of differences.
LAGS, ROLLS, STEPS = (1, 3, 5), (10, 20, 50), (1, 5)

#: The 32 base columns, by the names that base() gives them.
BASE = (
    "rsi14", "rsi7", "adx14", "pdi14", "mdi14", "macd_hist", "cmf20", "obv_slope", "bb_pos", "bb_width", "vol_yz20", "vol_yz50",
    "channel20", "channel50", "turnover_z20", "turnover_z50", "ema20_angle", "atr14_to_close_pct", "slope20", "ret_5d_spread", "gap_pct", "range_pct",
    "atr_pct", "body", "wick_skew", "compress_state", "mid_slope_atr", "slope_spread", "w_ret4", "w_ret13", "w_close_pos", "w_volume",
)

ALPHAS = (1, 7, 11, 14, 15, 24, 28, 34, 43, 46, 49, 51, 52, 53, 54, 56, 101)


def base(df: DataFrame) -> DataFrame:
    """Bars with the base columns."""
    d = daily.structure(daily.pivots(daily.oscillators(df)))
    d = daily.candles(daily.activity(daily.bands(daily.balance_volume(daily.money_flow(d)))))
    d = daily.weekly(daily.structural(d))
    atr = div(C("atr14"), C("close")) * 100
    angle = F.degrees(F.atan(div(w.delta(C("ema20")), w.delay(C("ema20"), 1))))
    d = d.withColumns({"macd_hist": C("macd") - C("macd_signal"), "atr_pct": atr, "atr14_to_close_pct": atr, "ema20_angle": angle})
    return d.select(*df.columns, *BASE)


def enough(df: DataFrame, least: int = 30) -> DataFrame:
    """Rows of symbols that have `least` of them."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy("symbol"))).where(C("_n") >= least).drop("_n")


def transforms(column: str) -> dict:
    """name -> lags, differences, and rolling means, deviations and percentile
    ranks of a column; rolling ones from a quarter of the window on, three
    values at least."""
    x = C(column).cast("double")
    out = {f"{column}_lag{n}": w.delay(x, n) for n in LAGS} | {f"{column}_diff{n}": w.delta(x, n) for n in STEPS}
    for n in ROLLS:
        out |= {f"{column}_{k}{n}": f(x, n, max(3, n // 4)) for k, f in (("rmean", w.mean), ("rstd", w.std), ("rrank", w.ts_rank))}
    return out


def generate(df: DataFrame, columns: list[str], least: int = 30) -> tuple[DataFrame, list[str]]:
    """(df with every transform of the columns, their names); symbols with too
    few rows are left out. All windows share partition and order."""
    made = {k: c for x in columns for k, c in transforms(x).items()}
    return enough(df, least).withColumns(made), list(made)


def _joined(a: tuple, b: tuple, n: int) -> tuple:
    """Number, mean and squares about the mean of frames of n rows (a) with the
    frames before them (b). Of equal means the mean is the same, the squares 0."""
    out = tuple(np.empty(x.shape) for x in a)
    for x, y in zip(out, a, strict=True):
        x[:n] = y[:n]
    (ka, ma, sa), (kb, mb, sb), (k, mean, squares) = (x[n:] for x in a), (x[:-n] for x in b), (x[n:] for x in out)
    np.add(ka, kb, out=k)
    step = np.divide(kb, np.maximum(k, 1.0, out=mean), out=mean)
    d = np.subtract(mb, ma, out=squares)
    step *= d
    d *= step
    d *= ka
    squares += sa
    squares += sb
    mean += ma
    return out


def _rolls(x: np.ndarray) -> dict[int, tuple]:
    """Number, mean and squares of the known values of every rolling window:
    frames of 1, 2, 4 and so on rows, put together, without cancellation."""
    known = x == x
    frames, out = {1: (known.astype("float64"), np.where(known, x, 0.0), np.zeros(x.shape))}, {}
    while (m := max(frames)) * 2 <= max(ROLLS):
        frames[2 * m] = _joined(frames[m], frames[m], m)
    for n in ROLLS:
        first, *rest = (m for m in sorted(frames, reverse=True) if n & m)
        have, long = frames[first], first
        for m in rest:
            have, long = _joined(have, frames[m], long), long + m
        out[n] = have
    return out


def _made(x: np.ndarray) -> dict[str, np.ndarray]:
    """transforms() of every column of a symbol's rows in time order, by the end
    of their names; missing is NaN. For ranks, windows are walked row offset by
    row offset for all columns at once."""
    rows, most = len(x), max(*ROLLS, *LAGS, *STEPS)
    x = np.ascontiguousarray(x)
    far = np.vstack([np.full((most, x.shape[1]), np.nan), x])
    back = lambda n: far[most - n:most - n + rows]
    out = {f"lag{n}": back(n) for n in LAGS} | {f"diff{n}": x - back(n) for n in STEPS}
    # Windows hold 255 rows at most, so counts fit a byte.
    below, same = (np.zeros(x.shape, dtype=np.uint8) for _ in range(2))
    is_so, rolls = np.empty(x.shape, dtype=bool), _rolls(x)
    with np.errstate(invalid="ignore", divide="ignore"):
        for n in range(1, max(ROLLS) + 1):
            v = back(n - 1)
            below += np.less(v, x, out=is_so).view(np.uint8)
            same += np.equal(v, x, out=is_so).view(np.uint8)
            if n in ROLLS:
                known, mean, squares = rolls[n]
                ok = known >= max(3, n // 4)
                out |= {f"rmean{n}": np.where(ok, mean, np.nan), f"rstd{n}": np.where(ok, np.sqrt(squares / (known - 1.0)), np.nan),
                        f"rrank{n}": np.where(ok & (x == x), (below + (same + 1.0) / 2) / known, np.nan)}
    return out


_TOTALS = "feature string, n long, total double"


def _total_over_all(d: DataFrame) -> DataFrame:
    return d.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0")


def summaries(df: DataFrame, columns: list[str], plain: list[str] = (), least: int = 30) -> DataFrame:
    """feature, n, total: number and sum of the known values of every transform
    of the columns, and of the plain columns, over the rows that generate()
    keeps. A symbol's transforms are made and summed in one grouped call, so the
    wide rows are nowhere written out."""
    names, plain = list(columns), list(plain)

    def run(t: pa.Table) -> pa.Table:
        if t.num_rows < least:
            return pa.table({"feature": pa.array([], pa.string()), "n": pa.array([], pa.int64()), "total": pa.array([], pa.float64())})
        t = t.take(pc.sort_indices(t, [("ts", "ascending")]))
        x = np.column_stack([t[c].to_numpy() for c in [*names, *plain]])
        parts = {k: v for k, v in _made(x[:, :len(names)]).items()}
        found = [([f"{c}_{k}" for c in names], v) for k, v in parts.items()] + [(plain, x[:, len(names):])]
        return pa.table({"feature": [f for fs, _ in found for f in fs], "n": np.concatenate([(v == v).sum(0) for _, v in found]),
                         "total": np.concatenate([np.nansum(v, 0) for _, v in found])})

    wide = df.select("symbol", "ts", *[C(c).cast("double").alias(c) for c in [*names, *plain]])
    return _total_over_all(wide.groupBy("symbol").applyInArrow(run, _TOTALS))


# --- base(), alphas() and their transforms in one pass -----------------------
# Arrays are (rows in time order, symbols), short symbols filled up at the end;
# missing is NaN. Frames add their values oldest first, as the window functions
# do: what is equal there is equal here, and ranks of it are.

_BAR = ("open", "high", "low", "close", "volume")

#: The day of a bar without one.
NO_DAY = -2 ** 31

#: Rows that are worked on at once, in whole symbols.
BLOCK = 16384


def factory(df: DataFrame, least: int = 30) -> DataFrame:
    """summaries() of the columns of base(), with those of alphas() plain. All
    columns are made of the bars where these lie sorted by symbol, some symbols
    at once, and leave a partition as sums: nothing wider than a bar is
    exchanged or sorted. Bars that lie by symbol already are not moved."""
    def run(batches):
        found: dict[str, list] = {}
        for t in _whole_symbols(batches):
            at = np.flatnonzero(t["_i"].to_numpy() == 1)
            for first, rows in _blocks(at, np.diff([*at, t.num_rows]), least):
                for k, (n, total) in _block_totals(t, first, rows).items():
                    have = found.setdefault(k, [0, 0.0])
                    have[0] += n
                    have[1] += total
        yield pa.RecordBatch.from_pydict({"feature": pa.array(list(found), pa.string()), "n": pa.array([n for n, _ in found.values()], pa.int64()),
                                          "total": pa.array([x for _, x in found.values()], pa.float64())})

    # The row number brings the rows of a symbol together, in time order.
    bar = df.select("symbol", "ts", F.unix_date(C("ts").cast("date")).alias("day"), *[C(k).cast("double").alias(k) for k in _BAR])
    bar = bar.withColumn("_i", F.row_number().over(w.series())).select("_i", C("symbol").isNotNull().alias("named"), "day", *_BAR)
    return _total_over_all(bar.mapInArrow(run, _TOTALS))


def _whole_symbols(batches):
    """Tables of whole symbols, of BLOCK rows and more (the last of fewer)."""
    kept, rows = [], 0
    for b in batches:
        at = np.flatnonzero(b.column("_i").to_numpy() == 1)
        if len(at) and rows + at[-1] >= BLOCK:
            yield pa.Table.from_batches([*kept, b.slice(0, at[-1])])
            kept, rows, b = [], 0, b.slice(at[-1])
        kept.append(b)
        rows += b.num_rows
    if rows:
        yield pa.Table.from_batches(kept)


def _blocks(first: np.ndarray, rows: np.ndarray, least: int):
    """(first rows, numbers of rows) of symbols of like length that make up about
    BLOCK rows, or of one longer symbol; those under `least` rows are left out."""
    order = np.argsort(-rows, kind="stable")
    order, a = order[rows[order] >= least], 0
    while a < len(order):
        longest = rows[order[a]]
        b = a + max(1, min(BLOCK // longest, int((rows[order[a:]] * 2 >= longest).sum())))
        yield first[order[a:b]], rows[order[a:b]]
        a = b


def _block_totals(t: pa.Table, first: np.ndarray, rows: np.ndarray) -> dict[str, tuple]:
    """name -> number and sum of the known values of every column."""
    i = np.arange(rows.max())[:, None]
    inside = i < rows
    at = np.where(inside, first + i, 0)
    take = lambda x, none: np.where(inside, x[at], none)
    o, h, low, c, v = (take(t[k].to_numpy(), np.nan) for k in _BAR)
    day = take(pc.fill_null(t["day"], NO_DAY).to_numpy(), NO_DAY)
    with np.errstate(all="ignore"):
        base, plain = _base(day, o, h, low, c, v, rows), _alphas(o, h, low, c, v)
        # Weeks are looked up by symbol, which finds none for an unknown one.
        named = t["named"].to_numpy()[first]
        base |= {k: np.where(named, x, np.nan) for k, x in base.items() if k.startswith("w_")}
    out = {}
    for k in BASE:
        out |= {f"{k}_{j}": _known(x, inside) for j, x in _made(np.where(inside, base[k], np.nan)).items()}
    return out | {k: _known(x, inside) for k, x in plain.items()}


def _known(x: np.ndarray, inside: np.ndarray) -> tuple[int, float]:
    ok = (x == x) & inside
    return int(np.count_nonzero(ok)), float(np.where(ok, x, 0.0).sum())


def _back(x: np.ndarray, n: int) -> np.ndarray:
    """Values n rows before."""
    return np.concatenate([np.full((min(n, len(x)), *x.shape[1:]), np.nan), x[:max(len(x) - n, 0)]])


def _div(a, b):
    return np.where(b == 0, np.nan, a / b)


def _clip(x, lo, hi):
    return np.where(x == x, np.maximum(lo, np.minimum(hi, x)), np.nan)


def _ln(x):
    return np.where(x > 0, np.log(x), np.nan)


def _frames(n: int, x: np.ndarray):
    """(values, whether known) of the frames of n rows, oldest first."""
    far = np.concatenate([np.full((n - 1, *x.shape[1:]), np.nan), x])
    for j in range(n):
        v = far[j:j + len(x)]
        yield v, v == v


def _sums(n: int, x: np.ndarray) -> tuple:
    """How many values of the last n rows are known, and their sum."""
    k = total = 0
    for v, known in _frames(n, x):
        k, total = k + known, total + np.where(known, v, 0.0)
    return k, total


def _mean(n: int, least: int, x: np.ndarray) -> np.ndarray:
    k, s = _sums(n, x)
    return np.where(k >= least, s / k, np.nan)


def _total(n: int, least: int, x: np.ndarray) -> np.ndarray:
    k, s = _sums(n, x)
    return np.where(k >= least, s, np.nan)


def _std(n: int, least: int, x: np.ndarray) -> np.ndarray:
    k, mean, squares, d, step = (np.zeros(x.shape) for _ in range(5))
    for v, known in _frames(n, x):
        k += known
        np.subtract(v, mean, out=d)
        np.copyto(d, 0.0, where=~known)
        np.divide(d, np.maximum(k, 1.0, out=step), out=step)
        mean += step
        squares += np.multiply(np.subtract(d, step, out=step), d, out=step)
    return np.where(k >= max(least, 2), np.sqrt(squares / (k - 1.0)), np.nan)


def _zscore(n: int, x: np.ndarray) -> np.ndarray:
    least = max(10, n // 4)
    return _div(x - _mean(n, least, x), _std(n, least, x))


def _both(n: int, a: np.ndarray, b: np.ndarray) -> tuple:
    """Over the rows where both are known: number, squares of the first and of
    the second about their means, and products."""
    both = (a == a) & (b == b)
    k, ma, mb, aa, bb, ab = (np.zeros(a.shape) for _ in range(6))
    for (x, known), (y, _) in zip(_frames(n, np.where(both, a, np.nan)), _frames(n, np.where(both, b, np.nan)), strict=True):
        k += known
        many = np.maximum(k, 1.0)
        da, db = np.where(known, x - ma, 0.0), np.where(known, y - mb, 0.0)
        sa, sb = da / many, db / many
        ma += sa
        mb += sb
        aa += da * (da - sa)
        bb += db * (db - sb)
        ab += np.where(known, da * (y - mb), 0.0)
    return k, aa, bb, ab


def _corr(n: int, a: np.ndarray, b: np.ndarray, least: int | None = None) -> np.ndarray:
    k, aa, bb, ab = _both(n, a, b)
    return np.where(k >= (least or max(5, n // 2)), _div(ab / k, np.sqrt(aa / k) * np.sqrt(bb / k)), np.nan)


def _slope(n: int, y: np.ndarray) -> np.ndarray:
    k, aa, _, ab = _both(n, np.broadcast_to(np.arange(1.0, len(y) + 1)[:, None], y.shape), y)
    return np.where(k >= n, _div(ab, aa), np.nan)


def _count(n: int, x: np.ndarray) -> np.ndarray:
    """How many values of the last n rows are known."""
    k = np.cumsum(x == x, axis=0)
    out = k.copy()
    out[n:] -= k[:-n]
    return out


def _most(f, n: int, least: int, x: np.ndarray) -> np.ndarray:
    """f (fmax or fmin) of the last n rows, from frames that overlap."""
    top, m = x, 1
    while m < n:
        by = min(m, n - m)
        top, m = f(top, _back(top, by)), m + by
    return np.where(_count(n, x) >= least, top, np.nan)


def _so_far(x: np.ndarray) -> np.ndarray:
    """Running sum, from the first known value on."""
    known = x == x
    return np.where(np.logical_or.accumulate(known), np.cumsum(np.where(known, x, 0.0), axis=0), np.nan)


def _last_known(x: np.ndarray) -> np.ndarray:
    at = np.where(x == x, np.arange(len(x))[:, None], 0)
    return np.take_along_axis(x, np.maximum.accumulate(at), axis=0)


def _rolled(x: np.ndarray, n: int, least: int, kind: str) -> np.ndarray:
    return np.column_stack([w.rolled(np.ascontiguousarray(y), n, least, kind) for y in x.T])


def _ts_rank(n: int, least: int, x: np.ndarray) -> np.ndarray:
    """Percentile rank in the last n rows, 127 at most: counts fit a byte."""
    far, twice, is_so = np.concatenate([np.full((n - 1, *x.shape[1:]), np.nan), x]), np.zeros(x.shape, np.uint8), np.empty(x.shape, bool)
    for j in range(n):
        v = far[j:j + len(x)]
        twice += np.less(v, x, out=is_so).view(np.uint8)
        twice += np.less_equal(v, x, out=is_so).view(np.uint8)
    k = _count(n, x)
    return np.where((x == x) & (k >= least), (twice + 1.0) / 2 / np.maximum(k, 1), np.nan)


#: Rows up to which _ranks() compares every row with all before it.
RANK_ROWS = 2000


def _ranks(*xs: np.ndarray, least: int = 60) -> list[np.ndarray]:
    """expanding_rank() of every column."""
    x = np.hstack(xs)
    if len(x) > RANK_ROWS:
        return np.split(np.column_stack([w.expanding_rank(np.ascontiguousarray(y), least) for y in x.T]), len(xs), axis=1)
    # Places among the sorted values stand for the values; missing ones come last.
    order = np.argsort(x, axis=0)
    y, z = np.take_along_axis(x, order, axis=0), np.empty(x.shape, dtype=np.int16)
    np.put_along_axis(z, order, np.concatenate([np.zeros((1, x.shape[1]), np.int16), np.cumsum(y[1:] != y[:-1], axis=0, dtype=np.int16)]), axis=0)
    known = x == x
    z[~known] = np.iinfo(np.int16).max
    # Rows less and rows not greater, this one included, are twice the rank less one.
    twice, part, is_so = np.ones(x.shape), np.zeros(x.shape, np.uint8), np.empty(x.shape, bool)
    for j in range(1, len(x)):
        here = part[j:]
        here += np.less(z[:-j], z[j:], out=is_so[j:]).view(np.uint8)
        here += np.less_equal(z[:-j], z[j:], out=is_so[j:]).view(np.uint8)
        if j % 127 == 0 or j == len(x) - 1:
            twice += part
            part[:] = 0
    k = np.cumsum(known, axis=0)
    return np.split(np.where(known & (k >= least), (twice + 1) / 2 / np.maximum(k, 1), np.nan), len(xs), axis=1)


def _base(day, o, h, low, c, v, rows) -> dict[str, np.ndarray]:
    d = daily._oscillate({k: pd.DataFrame(x) for k, x in (("high", h), ("low", low), ("close", c))})
    d = {k: x.to_numpy() for k, x in d.items()}
    rng, pc1, turnover, atr, ema = h - low, _back(c, 1), c * v, _div(d["atr14"], c) * 100, d["ema20"]
    (known, flow), (many, volume) = _sums(20, _div((c - low) - (h - c), rng) * v), _sums(20, v)
    width, mean, change = 4 * _std(20, 1, c), _mean(20, 20, c), np.sign(c - pc1)
    ln = lambda a, b: _ln(_div(a, b))
    var = ln(o, pc1) ** 2 + 0.34 * ln(c, o) ** 2 + 0.66 * (ln(h, o) * ln(h, c) + ln(low, o) * ln(low, c))
    obv, bb_width = _so_far(np.where(change == change, change, 0.0) * v), _div(width, mean)
    out = {k: d[k] for k in ("rsi14", "rsi7", "adx14", "pdi14", "mdi14")}
    out |= {
        "macd_hist": d["macd"] - d["macd_signal"], "cmf20": np.where((known > 0) & (many > 0), _div(flow, volume), np.nan), "obv_slope": obv - _back(obv, 1),
        "bb_pos": _clip(_div(c - (mean - width / 2), width), -5.0, 5.0), "bb_width": bb_width, "ema20_angle": np.degrees(np.arctan(_div(ema - _back(ema, 1), _back(ema, 1)))),
        "atr14_to_close_pct": atr, "atr_pct": atr, "slope20": _slope(20, c), "ret_5d_spread": _std(50, 10, (_div(c, _back(c, 5)) - 1) * 100),
        "gap_pct": _div(o - pc1, pc1) * 100, "range_pct": _div(rng, c) * 100, "body": _clip(_div(c - o, rng), -1.0, 1.0),
        "wick_skew": _clip(_div((h - np.fmax(c, o)) - (np.fmin(c, o) - low), rng), -1.0, 1.0), "compress_state": _ts_rank(50, 10, bb_width),
        "mid_slope_atr": _div(_slope(10, (h + low) / 2), d["atr14"]), "slope_spread": _std(20, 5, _slope(5, c))}
    for n in (20, 50):
        lo, hi = _most(np.fmin, n, 1, _back(low, 1)), _most(np.fmax, n, 1, _back(h, 1))
        out |= {f"vol_yz{n}": np.sqrt(np.fmax(_mean(n, max(10, n // 3), var), 0.0)), f"turnover_z{n}": _zscore(n, turnover),
                f"channel{n}": _clip(_div(c - lo, hi - lo), -1.0, 2.0)}
    weeks = [_weekly(*(x[:n, s] for x in (day, h, low, c, v))) for s, n in enumerate(rows)]
    fill = lambda x: np.concatenate([x, np.full(len(c) - len(x), np.nan)])
    return out | {k: np.column_stack([fill(x[k]) for x in weeks]) for k in weeks[0]}


def _weekly(day, h, low, c, v) -> dict[str, np.ndarray]:
    """The columns of one symbol's weeks."""
    week = np.where(day == NO_DAY, NO_DAY, day + (1 - day) % 7)  # day 1 is a Friday
    at = np.flatnonzero(np.concatenate([[True], week[1:] != week[:-1]]))
    last = np.concatenate([at[1:], [len(week)]]) - 1
    close, top, bottom = np.where(week[at] == NO_DAY, np.nan, c[last]), np.fmax.reduceat(h, at), np.fmin.reduceat(low, at)
    volume = np.where(np.logical_or.reduceat(v == v, at), np.add.reduceat(np.where(v == v, v, 0.0), at), np.nan)
    made = {"w_ret4": (_div(close, _back(close, 4)) - 1) * 100, "w_ret13": (_div(close, _back(close, 13)) - 1) * 100,
            "w_close_pos": _clip(_div(close - bottom, top - bottom), 0.0, 1.0), "w_volume": _div(volume, _mean(4, 2, _back(volume, 1)))}
    ok = (week != NO_DAY) & (len(at) >= 5)
    return {k: np.where(ok, np.repeat(_back(x, 1), last - at + 1), np.nan) for k, x in made.items()}


def _alphas(o, h, low, c, v) -> dict[str, np.ndarray]:
    v, known = np.where(v == v, v, 0.0), _last_known(c)
    ret, under, d7, ratio = _div(known, _back(known, 1)) - 1, (h + low + c) / 3 - c, c - _back(c, 7), 1 - _div(h - c, c - low)
    low5, power, adv, month, year = _most(np.fmin, 5, 3, low), np.sign(ret) * ret * ret, _mean(20, 5, v), _total(20, 5, ret), _rolled(ret, 240, 50, "total")
    busy, burst = _div(v, adv), _div(_total(10, 3, ret), _total(3, 1, _total(2, 1, ret)))
    rank7, rbusy, rfall = _ts_rank(60, 30, np.abs(d7)), _ts_rank(20, 10, busy), _ts_rank(8, 4, -d7)
    r_high, r_vol, r_top, r_least, r_vol3, r_ret3, r_sd, r_co, r_gain, r_burst, r_flow = _ranks(
        h, v, _most(np.fmax, 3, 3, under), _most(np.fmin, 3, 3, under), v - _back(v, 3), ret - _back(ret, 3), _std(2, 2, ret), _corr(5, c, o), _div(year - month, month), burst, ret * c * v)
    r_c15, r_x34 = _ranks(_corr(3, r_high, r_vol, 3), (1 - r_sd) + (1 - r_co))
    scale = lambda x: _div(x, _so_far(np.abs(x)))
    last = np.minimum(np.arange(len(c)), 4)[:, None]
    place = np.argmax([np.where(k, x, -np.inf) for x, k in _frames(5, power)], axis=0) - (4 - last)
    bend = (_back(c, 20) - _back(c, 10)) / 10 - (_back(c, 10) - c) / 10
    back, fall = (_back(c, 20) - _back(c, 30)) / 10, -(c - _back(c, 1))
    return {
        "f1": np.where(_count(5, power) >= 3, place / last - 0.5, np.nan), "f7": np.where(adv < v, -rank7 * np.sign(d7), -1.0), "f11": r_top + r_least * r_vol3,
        "f14": -r_ret3 * _corr(10, o, v), "f15": -_total(3, 1, r_c15), "f24": _div(_rolled(c, 100, 50, "mean"), _back(c, 100)) - 1, "f28": scale(_corr(5, adv, low)) + scale(c - o),
        "f34": r_x34, "f43": rbusy * rfall, "f46": np.where(bend > 0.25, -1.0, 1.0), "f49": np.where(back > 0.1, -1.0, fall), "f51": np.where(back > 0.05, -1.0, fall),
        "f52": (_back(low5, 5) - low5) * r_gain, "f53": -(ratio - _back(ratio, 9)), "f54": _div(-(low - c) * o ** 5, (low - h) * c ** 5), "f56": -(r_burst * r_flow),
        "f101": (c - o) / (h - low + 0.001)}


def _running_scale(x):
    """x over the sum of its absolute values so far: the scale over the whole
    series would know the future."""
    return div(x, F.sum(F.abs(x)).over(so_far("symbol")))


def alphas(df: DataFrame) -> DataFrame:
    """Seventeen alphas, f1 to f101. r() is the expanding rank from 60 values
    on (a rank within the whole series would look ahead). A NULL volume is 0. A
    comparison with an unknown side is false. f1 is the place of the greatest
    change in the window, in which an unknown change is never the greatest. f15
    and f34 have full windows of 3 and 2 values."""
    o, h, low, c = (C(k) for k in ("open", "high", "low", "close"))
    v, ret = C("_vol"), C("_ret")
    d = df.withColumns({"_vol": F.coalesce(C("volume").cast("double"), F.lit(0.0)), "_ret": w.pct_change(c), "_under": (h + low + c) / 3 - c,
                        "_d7": w.delta(c, 7), "_fall7": -w.delta(c, 7), "_low5": w.low(low, 5, 3), "_ratio": 1 - div(h - c, c - low)})
    d = d.withColumns({"_pow": F.signum(ret) * ret * ret, "_adv": w.mean(v, 20, 5), "_top3": w.high(C("_under"), 3, 3), "_least3": w.low(C("_under"), 3, 3), "_vol3": w.delta(v, 3),
                       "_ret3": w.delta(ret, 3), "_sd2": w.std(ret, 2, 2), "_co5": w.corr(c, o, 5), "_m": w.total(ret, 20, 5), "_t10": w.total(ret, 10, 3),
                       "_t2": w.total(ret, 2, 1), "_flow": ret * c * v, "_abs7": F.abs(C("_d7"))})
    d = d.withColumns({"_t23": w.total(C("_t2"), 3, 1), "_busy": div(v, C("_adv")), "_al5": w.corr(C("_adv"), low, 5)})
    d = w.recursive(d, {"_y": ("total", "_ret", 240, 50), "_c100": ("mean", "close", 100, 50), "_rank7": ("ts_rank", "_abs7", 60, 30), "_rbusy": ("ts_rank", "_busy", 20, 10), "_rfall": ("ts_rank", "_fall7", 8, 4)})
    d = d.withColumns({"_burst": div(C("_t10"), C("_t23")), "_gain": div(C("_y") - C("_m"), C("_m"))})
    d = w.recursive(d, {f"r_{k}": ("rank", k, 60) for k in ("high", "_vol", "_top3", "_least3", "_vol3", "_ret3", "_sd2", "_co5", "_gain", "_burst", "_flow")})
    d = d.withColumns({"_c15": w.corr(C("r_high"), C("r__vol"), 3, 3), "_x34": (1 - C("r__sd2")) + (1 - C("r__co5"))})
    d = w.recursive(d, {"r2_c15": ("rank", "_c15", 60), "r2_x34": ("rank", "_x34", 60)})
    place = F.collect_list(F.coalesce(C("_pow"), F.lit(float("-inf")))).over(w.roll(5))
    bend = (w.delay(c, 20) - w.delay(c, 10)) / 10 - (w.delay(c, 10) - c) / 10
    back = (w.delay(c, 20) - w.delay(c, 30)) / 10
    return d.withColumns({
        "f1": F.when(F.count("_pow").over(w.roll(5)) >= 3, (F.array_position(place, F.array_max(place)) - 1) / (F.size(place) - 1) - 0.5),
        "f7": F.when(C("_adv") < v, -C("_rank7") * F.signum(C("_d7"))).otherwise(-1.0), "f11": C("r__top3") + C("r__least3") * C("r__vol3"),
        "f14": -C("r__ret3") * w.corr(o, v, 10), "f15": -w.total(C("r2_c15"), 3, 1), "f24": div(C("_c100"), w.delay(c, 100)) - 1,
        "f28": _running_scale(C("_al5")) + _running_scale(c - o), "f34": C("r2_x34"), "f43": C("_rbusy") * C("_rfall"),
        "f46": F.when(bend > 0.25, -1.0).otherwise(1.0), "f49": F.when(back > 0.1, -1.0).otherwise(-w.delta(c)), "f51": F.when(back > 0.05, -1.0).otherwise(-w.delta(c)),
        "f52": (w.delay(C("_low5"), 5) - C("_low5")) * C("r__gain"), "f53": -w.delta(C("_ratio"), 9), "f54": div(-(low - c) * o ** 5, (low - h) * c ** 5),
        "f56": -(C("r__burst") * C("r__flow")), "f101": (c - o) / (h - low + 0.001),
    }).select(*df.columns, *[f"f{i}" for i in ALPHAS])
