"""Daily indicators of one bar series per symbol. Every column is causal. The
recursive ones (exponential means) come from one grouped kernel; all others are
window expressions over the same partition and order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.functions.exprs import clip, div, flag, series, so_far
from panelforge.operators import windows as w

C = F.col


def _oscillate(p: pd.DataFrame) -> dict[str, pd.Series]:
    c, h, low = (p[k] for k in ("close", "high", "low"))
    wilder = lambda x, n: x.ewm(alpha=1 / n, adjust=False, min_periods=n).mean()
    ema = lambda x, n: x.ewm(span=n, adjust=False, min_periods=1).mean()
    none = lambda x: x.where(x != 0)
    out = {f"ema{n}": ema(c, n) for n in (20, 50, 100)}
    out["macd"] = ema(c, 12) - ema(c, 26)
    out["macd_signal"] = ema(out["macd"], 9)
    step = c.diff()
    for n in (7, 14):
        ratio = wilder(step.clip(lower=0), n) / none(wilder(-step.clip(upper=0), n))
        out[f"rsi{n}"] = 100 - 100 / (1 + ratio)
    prev = c.shift(1)
    tr = np.fmax(h - low, np.fmax((h - prev).abs(), (low - prev).abs()))
    for n in (14, 30):
        out[f"atr{n}"] = wilder(tr, n)
    up, down = h.diff(), -low.diff()
    for name, move in (("pdi14", up.where((up > down) & (up > 0), 0.0)), ("mdi14", down.where((down > up) & (down > 0), 0.0))):
        out[name] = 100 * wilder(move, 14) / none(out["atr14"])
    total = out["pdi14"] + out["mdi14"]
    out["adx14"] = wilder(100 * (out["pdi14"] - out["mdi14"]).abs() / none(total), 14)
    return out


OSCILLATORS = ("ema20", "ema50", "ema100", "macd", "macd_signal", "rsi7", "rsi14", "atr14", "atr30", "pdi14", "mdi14", "adx14")


def oscillators(df: DataFrame) -> DataFrame:
    """Adds the exponential means, MACD, RSI, ATR and ADX family: one exchange
    on the symbol, one grouped call for all of them."""
    return w.grouped(df, list(OSCILLATORS), ["high", "low", "close"], _oscillate)


def money_flow(df: DataFrame) -> DataFrame:
    """Chaikin money flow over 20 bars, one value at least."""
    v = div((C("close") - C("low")) - (C("high") - C("close")), C("high") - C("low")) * C("volume")
    return df.withColumn("cmf20", div(F.sum(v).over(series().rowsBetween(-19, 0)), F.sum("volume").over(series().rowsBetween(-19, 0))))


def relation(base_lo, base_hi, lo, hi):
    """Above, Below or Inside of a base range; NULL if any side is."""
    known = base_lo.isNotNull() & base_hi.isNotNull() & lo.isNotNull() & hi.isNotNull()
    inside = (lo <= base_hi) & (hi >= base_lo)
    # A range that is upside down (top under bottom) can be both; later wins.
    return F.when(known, F.when(inside, "Inside").when(hi < base_lo, "Below").when(lo > base_hi, "Above").otherwise("Overlap"))


def pivots(df: DataFrame) -> DataFrame:
    """Previous bar, inside bars, pivot range with supports and resistances,
    and how today's range lies to yesterday's."""
    h, low, c = C("high"), C("low"), C("close")
    d = df.withColumns({"prev_high": w.delay(h, 1), "prev_low": w.delay(low, 1), "prev_close": w.delay(c, 1),
                        "pivot": (h + low + c) / 3, "bc": (h + low) / 2})
    d = d.withColumns({"tc": 2 * C("pivot") - C("bc"), "inside_day": flag((h <= C("prev_high")) & (low >= C("prev_low")))})
    d = d.withColumns({"support1": 2 * C("pivot") - h, "resistance1": 2 * C("pivot") - low, "support2": C("pivot") - (h - low), "resistance2": C("pivot") + (h - low),
                       "cpr_width_pct": div(C("tc") - C("bc"), c) * 100, "prev_inside_day": w.delay(C("inside_day"), 1),
                       "cpr_vs_prev": relation(w.delay(C("bc"), 1), w.delay(C("tc"), 1), C("bc"), C("tc"))})
    return d.withColumn("cpr_code", F.coalesce(F.when(C("cpr_vs_prev") == "Above", 1).when(C("cpr_vs_prev") == "Below", -1), F.lit(0)))


def period_trend(df: DataFrame, period, name: str) -> DataFrame:
    """1, -1 or 0: the high so far this period against the last period's high.
    Periods are aggregated once and joined back."""
    d = df.withColumn("_p", period)
    top = d.groupBy("symbol", "_p").agg(F.max("high").alias("_m"))
    top = top.select(C("symbol").alias("_s"), C("_p").alias("_q"), F.lag("_m").over(Window.partitionBy("symbol").orderBy("_p")).alias("_last"))
    d = d.join(top, (d.symbol == top._s) & (d._p == top._q), "left")
    run = F.max("high").over(so_far("symbol", "_p"))
    return d.withColumn(name, F.coalesce(F.signum(run - C("_last")).cast("int"), F.lit(0))).drop("_p", "_s", "_q", "_last")


def week_end(ts):
    """The Friday that ends the week (Saturday to Friday) of a date."""
    return F.next_day(F.date_sub(ts, 1), "FRI")


def structure(df: DataFrame) -> DataFrame:
    """Higher and lower highs and lows, their trend codes and runs, open
    location and day type; needs pivots()."""
    h, low, rng = C("high"), C("low"), C("high") - C("low")
    d = df.withColumns({"hh": flag(h > C("prev_high")), "hl": flag(low > C("prev_low")), "lh": flag(h < C("prev_high")), "ll": flag(low < C("prev_low"))})
    d = d.withColumns({
        "daily_trend": F.when(C("lh") == 1, -1).when(C("hh") == 1, 1).otherwise(0),
        "structure": F.when((C("hh") == 1) & (C("hl") == 1), "uptrend").when((C("lh") == 1) & (C("ll") == 1), "downtrend").otherwise("range"),
        "open_location": div(C("open") - low, rng),
        "day_type": F.when(C("open") > C("tc"), "bullish").when(C("open") < C("bc"), "bearish").otherwise("inside")})
    for k in ("hh", "ll"):
        d = w.with_streak(d, C(k) == 1, f"{k}_run")
    d = period_trend(d, week_end(C("ts")), "weekly_trend")
    return period_trend(d, F.trunc("ts", "month"), "monthly_trend")


def narrow_range(df: DataFrame) -> DataFrame:
    """NR7, how long it has held, and the widest window (20 to 5 bars) of which
    this bar's range is the smallest."""
    d = df.withColumn("_r", C("high") - C("low"))

    def smallest(n):
        f = series().rowsBetween(-(n - 1), -1)
        return (F.count("_r").over(f) >= n - 1) & (C("_r") < F.min("_r").over(f))

    d = d.withColumn("nr7", flag(smallest(7)))
    d = d.withColumn("nr_day", F.coalesce(*[F.when(smallest(n), n) for n in range(20, 4, -1)]))
    return w.with_streak(d, C("nr7") == 1, "nr_length").drop("_r")


def averages(df: DataFrame) -> DataFrame:
    c = C("close")
    d = df.withColumns({f"sma{n}": w.mean(c, n) for n in (5, 20, 50, 200)})
    return d.withColumn("golden", flag((c > C("sma200")) & (C("sma50") > C("sma200"))))


def momentum_flags(df: DataFrame) -> DataFrame:
    """Whether the exponential means are stacked (20 over 50 over 100) and RSI 7
    is over RSI 14; needs oscillators()."""
    return df.withColumns({"ema_stack": flag((C("ema20") > C("ema50")) & (C("ema50") > C("ema100"))), "rsi7_over_14": flag(C("rsi7") > C("rsi14"))})


def structural(df: DataFrame) -> DataFrame:
    """Rank of the band's width among 50 bars, distances from the highs and lows
    before in ATRs, runs of higher lows and lower highs, and the midpoint's slope
    in ATRs; needs oscillators(), pivots(), structure() and bands()."""
    atr, h = C("atr14"), C("high")
    year = series().rowsBetween(-252, -1)
    top = F.when(F.count(h).over(year) >= 50, F.max(h).over(year))
    d = df.withColumns({"compress_state": w.ts_rank(C("bb_width"), 50, 10), "from_20h": div(C("close") - C("hi20"), atr), "from_20l": div(C("close") - C("lo20"), atr),
                        "from_52wh": div(C("close") - top, atr), "mid_slope_atr": div(w.slope((h + C("low")) / 2, 10), atr)})
    for k in ("hl", "lh"):
        d = w.with_streak(d, C(k) == 1, f"{k}_run")
    return d


def year_scores(df: DataFrame) -> DataFrame:
    """Scores over 252 bars of RSI, ATR in per cent, volume, EMA angle and
    turnover, and RSI by OBV slope; needs oscillators() and balance_volume()."""
    d = df.withColumns({"atr_pct": div(C("atr14"), C("close")) * 100, "_t": C("close") * C("volume"),
                        "_a": F.degrees(F.atan(div(w.delta(C("ema20")), w.delay(C("ema20"), 1))))})
    cols = {"rsi14": "rsi14", "atr_pct": "atr_pct", "volume": "volume", "ema20_angle": "_a", "turnover": "_t"}
    d = d.withColumns({f"{k}_z252": w.zscore(C(v), 252) for k, v in cols.items()})
    return d.withColumns({"rsi14_obv_x": C("rsi14") * C("obv_slope"), "rsi7_obv_x": C("rsi7") * C("obv_slope")}).drop("_t", "_a")


def balance_volume(df: DataFrame) -> DataFrame:
    d = df.withColumn("_m", F.coalesce(F.signum(w.delta(C("close"))), F.lit(0.0)) * C("volume"))
    d = d.withColumn("obv", F.sum("_m").over(so_far("symbol"))).drop("_m")
    d = d.withColumn("obv_slope", w.delta(C("obv")))
    return d.withColumn("both_rising", flag((w.delta(C("close")) > 0) & (C("obv_slope") > 0)))


def bands(df: DataFrame) -> DataFrame:
    """Bollinger position and width, channel positions, breakouts and the bars
    since, and the range-based volatility of 20 and 50 bars."""
    o, h, low, c = C("open"), C("high"), C("low"), C("close")
    width = 4 * w.std(c, 20, 1)
    d = df.withColumns({"bb_pos": clip(div(c - (w.mean(c, 20) - width / 2), width), -5, 5), "bb_width": div(width, w.mean(c, 20)), "_pc": w.delay(c, 1)})
    ln = lambda a, b: F.ln(div(a, b))
    var = ln(o, C("_pc")) ** 2 + 0.34 * ln(c, o) ** 2 + 0.66 * (ln(h, o) * ln(h, c) + ln(low, o) * ln(low, c))
    d = d.withColumn("_v", var)
    for n in (20, 50):
        before = series().rowsBetween(-n, -1)
        d = d.withColumns({f"hi{n}": F.max(h).over(before), f"lo{n}": F.min(low).over(before), f"vol_yz{n}": F.sqrt(F.greatest(w.mean(C("_v"), n, max(10, n // 3)), F.lit(0.0)))})
        d = d.withColumns({f"channel{n}": clip(div(c - C(f"lo{n}"), C(f"hi{n}") - C(f"lo{n}")), -1, 2), f"break_up{n}": flag(h > C(f"hi{n}")), f"break_down{n}": flag(low < C(f"lo{n}"))})
    d = w.with_since(d, C("break_up20") == 1, "since_up20")
    return w.with_since(d, C("break_down20") == 1, "since_down20").drop("_v", "_pc")


def activity(df: DataFrame) -> DataFrame:
    """Turnover scores, volume surges, range and gap in per cent, the label of
    five bars on and the spread of the labels that are known."""
    c, v = C("close"), C("volume")
    d = df.withColumns({"turnover": c * v, "range_pct": div(C("high") - C("low"), c) * 100, "gap_pct": div(C("open") - w.delay(c, 1), w.delay(c, 1)) * 100,
                        "ret_5d": (div(w.lead(c, 5), c) - 1) * 100, "_back": (div(c, w.delay(c, 5)) - 1) * 100})
    d = d.withColumns({f"turnover_z{n}": w.zscore(C("turnover"), n) for n in (20, 50, 252)})
    for n, least in ((20, 5), (50, 10)):
        d = d.withColumn(f"surge{n}", flag(v > w.mean(v, n, least) + 2 * w.std(v, n, least)))
    return d.withColumn("ret_5d_spread", w.std(C("_back"), 50, 10)).drop("_back")


def candles(df: DataFrame) -> DataFrame:
    """Body and wick shape, expansion, and slopes of close and midpoint."""
    o, h, low, c = C("open"), C("high"), C("low"), C("close")
    rng = h - low
    d = df.withColumns({"body": clip(div(c - o, rng), -1, 1), "wick_skew": clip(div((h - F.greatest(c, o)) - (F.least(c, o) - low), rng), -1, 1),
                        "expand": flag(rng > w.delay(rng, 1)), "slope20": w.slope(c, 20), "slope50": w.slope(c, 50), "mid_slope10": w.slope((h + low) / 2, 10), "_s5": w.slope(c, 5)})
    return d.withColumn("slope_spread", w.std(C("_s5"), 20, 5)).drop("_s5")


def weekly(df: DataFrame) -> DataFrame:
    """Momentum, close position and volume of the weeks, known one week later.
    Weeks of a symbol count when it has five at least."""
    wk = df.groupBy("symbol", week_end(C("ts")).alias("wk")).agg(F.max_by("close", "ts").alias("c"), F.max("high").alias("h"), F.min("low").alias("l"), F.sum("volume").alias("v"))
    by = Window.partitionBy("symbol").orderBy("wk")
    # Weeks without a bar are not rows: positions count weeks that have one.
    before = by.rowsBetween(-4, -1)
    vols = F.when(F.count("v").over(before) >= 2, F.avg("v").over(before))
    wk = wk.select("symbol", "wk", ((div(C("c"), F.lag("c", 4).over(by)) - 1) * 100).alias("a"), ((div(C("c"), F.lag("c", 13).over(by)) - 1) * 100).alias("b"),
                   clip(div(C("c") - C("l"), C("h") - C("l")), 0, 1).alias("p"), div(C("v"), vols).alias("q"), F.count("*").over(Window.partitionBy("symbol")).alias("n"))
    late = {"w_ret4": "a", "w_ret13": "b", "w_close_pos": "p", "w_volume": "q"}
    wk = wk.select(C("symbol").alias("_s"), C("wk").alias("_w"), *[F.when(C("n") >= 5, F.lag(v).over(by)).alias(k) for k, v in late.items()])
    d = df.withColumn("_k", week_end(C("ts")))
    return d.join(wk, (d.symbol == wk._s) & (d._k == wk._w), "left").drop("_s", "_w", "_k")


def volume_node(values, volumes, bins: int):
    """Middle of the price bin with most volume (the first of equals), of two
    arrays: a histogram by higher-order functions."""
    lo, hi = F.array_min(values), F.array_max(values)
    at = lambda x: F.least(F.floor((x - lo) / (hi - lo) * bins).cast("int"), F.lit(bins - 1))
    pairs = F.arrays_zip(values.alias("p"), volumes.alias("v"))
    sums = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.aggregate(
        F.filter(pairs, lambda x: at(x["p"]) == b), F.lit(0.0), lambda acc, x: acc + x["v"]))
    k = F.array_position(sums, F.array_max(sums)) - 1
    return F.when(hi <= lo, lo).otherwise(lo + (hi - lo) * (2 * k + 1) / (2 * bins))


def week_node(df: DataFrame, bins: int = 50) -> DataFrame:
    """The running volume node of the week, from its bars so far only."""
    d = df.withColumn("_k", week_end(C("ts")))
    past = so_far("symbol", "_k")
    d = d.withColumns({"_p": F.collect_list((C("high") + C("low") + C("close")) / 3).over(past), "_v": F.collect_list("volume").over(past)})
    return d.withColumn("week_node", volume_node(C("_p"), C("_v"), bins)).drop("_k", "_p", "_v")


def alphas(df: DataFrame) -> DataFrame:
    """Sixteen formula alphas. r() is the expanding rank from 60 values on; one
    grouped call for the first ranks, one for the ranks of what they make and
    one for a29's third rank, which has its first value at bar 183."""
    o, h, low, c, v = (C(k) for k in ("open", "high", "low", "close", "volume"))
    ret = w.pct_change(c)
    d = df.withColumns({"_ret": ret, "_d5": w.delta(c, 5), "_oc": -1 + div(o, c), "_co": div(c, o), "_o1": o - w.delay(h, 1), "_o2": o - w.delay(c, 1), "_o3": o - w.delay(low, 1),
                        "_sd": w.std(h, 10, 5), "_d7": w.delta(c, 7)})
    d = d.withColumns({"_tr10": w.ts_rank(c, 10), "_y250": 1 + w.total(C("_ret"), 250, 50)})
    first = ["open", "high", "close", "volume", "_d5", "_oc", "_co", "_o1", "_o2", "_o3", "_sd", "_y250", "_tr10"]
    d = w.recursive(d, {f"r_{k}": ("rank", k, 60) for k in first})
    d = d.withColumns({"_c13": w.cov(C("r_close"), C("r_volume"), 5, 3), "_c16": w.cov(C("r_high"), C("r_volume"), 5, 3),
                       "_rv5": w.ts_rank(v, 5), "_rh5": w.ts_rank(h, 5), "_n29": -C("r__d5")})
    d = d.withColumn("_c26", w.corr(C("_rv5"), C("_rh5"), 5))
    d = w.recursive(d, {"r2_c13": ("rank", "_c13", 60), "r2_c16": ("rank", "_c16", 60), "r2_d5": ("rank", "_n29", 60)})
    d = w.recursive(d, {"r3_d5": ("rank", "r2_d5", 60)})
    return d.withColumns({
        "a3": -w.corr(C("r_open"), C("r_volume"), 10), "a6": -w.corr(o, v, 10), "a12": F.signum(w.delta(v)) * -w.delta(c), "a13": -C("r2_c13"), "a16": -C("r2_c16"),
        "a19": -F.signum(w.delta(C("_d7"), 5) + w.delta(c, 5)) * (1 + C("r__y250")),
        "a20": -C("r__o1") * C("r__o2") * C("r__o3"), "a23": F.when(w.mean(h, 20, 10) < h, -w.delta(h, 2)).otherwise(0.0),
        "a26": -w.high(C("_c26"), 3, 3), "a29": C("r3_d5"), "a33": C("r__oc"), "a35": w.ts_rank(v, 32) * (1 - w.ts_rank(c + h - low, 16)) * (1 - w.ts_rank(C("_ret"), 32)),
        "a38": -C("r__tr10") * C("r__co"), "a40": -C("r__sd") * w.corr(h, v, 10), "a41": F.sqrt(h * low) - (h + low + c) / 3, "a44": -w.corr(h, C("r_volume"), 5),
    }).select(*df.columns, *[f"a{i}" for i in (3, 6, 12, 13, 16, 19, 20, 23, 26, 29, 33, 35, 38, 40, 41, 44)])


def combos(df: DataFrame) -> DataFrame:
    """Five joint conditions; needs oscillators() and pivots()."""
    d = df.withColumns({"_rsi": w.delta(C("rsi14")), "_gap": C("open") - C("prev_close"), "_atr": div(C("atr14"), C("close")) * 100, "_ang": div(w.delta(C("ema20")), w.delay(C("ema20"), 1))})
    return d.withColumns({
        "rsi_up_adx_mid": flag((C("_rsi") > 0) & C("adx14").between(15, 25)), "gap_up_above": flag((C("_gap") > 0) & (C("cpr_code") == 1)),
        "gap_down_below": flag((C("_gap") < 0) & (C("cpr_code") == -1)), "calm_up": flag((C("_atr") <= 2) & (C("_ang") > 0)), "wild_down": flag((C("_atr") >= 4) & (C("_ang") < 0)),
        "ema20_angle": F.degrees(F.atan(C("_ang")))}).drop("_rsi", "_gap", "_atr", "_ang")


def transforms(df: DataFrame, column: str) -> DataFrame:
    """Lags, differences, rolling means, deviations and ranks of one column."""
    x = C(column)
    return df.withColumns({**{f"{column}_lag{n}": w.delay(x, n) for n in (1, 3, 5)}, **{f"{column}_diff{n}": w.delta(x, n) for n in (1, 5)},
                           **{f"{column}_{k}{n}": f(x, n, max(3, n // 2)) for n in (10, 20) for k, f in (("mean", w.mean), ("std", w.std), ("rank", w.ts_rank))}})
