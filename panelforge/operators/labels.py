"""Forward labels, regimes and time splits. Columns whose name starts with fwd,
ret_ or label look ahead; nothing else here does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.functions.exprs import div, flag, series
from panelforge.operators import windows as w

C = F.col


def forward(df: DataFrame, horizons: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Returns over the next bars (close to close, and next open to close, in
    per cent) and the best and worst price on the way."""
    d = df
    for n in horizons:
        end = w.lead(C("close"), n)
        d = d.withColumns({f"ret_{n}d_cc": (div(end, C("close")) - 1) * 100, f"ret_{n}d_oc": (div(end, w.lead(C("open"), 1)) - 1) * 100,
                           f"fwd_mfe{n}": (div(w.forward_high(C("high"), n), C("close")) - 1) * 100, f"fwd_mae{n}": (div(w.forward_low(C("low"), n), C("close")) - 1) * 100})
    return d


def bias(df: DataFrame) -> DataFrame:
    """Adds long_score and short_score: a band of RSI 14 (50 to 70 long, under
    45 short) less penalties for a wide ATR (over 4 % of the close, 0.5) and a
    wide pivot range (over 1 %, 0.3). Unknown values neither score nor cost."""
    wide = flag(div(C("atr14"), C("close")) * 100 > 4) * 0.5 + flag(F.abs("cpr_width_pct") > 1) * 0.3
    return df.withColumns({"long_score": flag(C("rsi14").between(50, 70)) - wide, "short_score": flag(C("rsi14") < 45) - wide})


def market_regime(df: DataFrame, wide: int = 200, spread: int = 250, least: int = 50) -> DataFrame:
    """One row a date: trend (mean over `wide` dates of the cross-section's mean
    return in per cent), high_vol (whether its deviation is over the median of
    `spread` dates) and dispersion (that deviation), all as they stood the date
    before: a date's own returns change nothing in its row. The dates are one
    small series."""
    r = df.withColumn("_r", w.pct_change(C("close")) * 100)
    d = r.groupBy("ts").agg(F.avg("_r").alias("_m"), F.stddev_samp("_r").alias("_s"))
    o = Window.partitionBy(F.lit("market")).orderBy("ts")
    known = lambda x, n, agg: F.when(F.count(x).over(o.rowsBetween(-n, -1)) >= least, agg.over(o.rowsBetween(-n, -1)))
    d = d.withColumns({"trend": known("_m", wide, F.avg("_m")), "dispersion": F.lag("_s").over(o), "_med": known("_s", spread, F.percentile("_s", 0.5))})
    return d.select("ts", "trend", flag(C("dispersion") > C("_med")).alias("high_vol"), "dispersion")


def stock_regime(df: DataFrame, lag: int = 1) -> DataFrame:
    """Adds regime: bull over the mean of 200 closes, else bear; _range under an
    ADX of 20, else _trend (unknown place is bear, unknown strength trend), and
    regime_lag, that of `lag` bars before (bull_trend at a series' start). With
    it the continuous measures: dist_sma200, adx, their product and two soft
    memberships. Needs sma200 and adx14."""
    place = div(C("close"), C("sma200")) - 1
    side = F.when(C("close") > C("sma200"), "bull").otherwise("bear")
    d = df.withColumn("regime", F.concat(side, F.when(C("adx14") < 20, "_range").otherwise("_trend")))
    soft = lambda x: 1 / (1 + F.exp(-x))
    return d.withColumns({
        "regime_lag": F.coalesce(F.lag("regime", lag).over(series()), F.lit("bull_trend")), "regime_dist_sma200": place, "regime_adx": C("adx14"),
        "regime_dist_x_adx": place * C("adx14"), "regime_bull_soft": soft(place * 20), "regime_trend_soft": soft((C("adx14") - 22.5) / 5)})


def scaled_target(df: DataFrame, ret: str, bars: int = 20, floor: float = 0.05) -> DataFrame:
    """The return over the stock's own spread (range where that is unknown, and
    the cross-section's floor quantile at least), its rank that day, and the
    top and bottom fifth as classes 1 and 0."""
    one = w.pct_change(C("close")) * 100
    d = df.withColumn("_1", one).withColumn("_v", F.coalesce(w.std(C("_1"), bars, bars // 2), div(C("high") - C("low"), C("close")) * 100))
    d = d.withColumn("_v", w.xs_floor(F.when(C("_v") > 0, C("_v")), floor, "ts"))
    d = d.withColumn("fwd_scaled", div(C(ret), C("_v")))
    d = d.withColumn("fwd_rank", w.xs_rank(C("fwd_scaled"), "ts"))
    return d.withColumn("label", F.when(C("fwd_rank") >= 0.8, 1).when(C("fwd_rank") <= 0.2, 0)).drop("_1", "_v")


def target(df: DataFrame, n: int, leg: str = "oc", basis: str | None = None, percent: bool = True) -> Column:
    """The return over n bars, from this close (cc) or the next open (oc), over
    a scale column in per cent of price (basis) if one is named."""
    start = C("close") if leg == "cc" else w.lead(C("open"), 1)
    ret = (div(w.lead(C("close"), n), start) - 1) * (100 if percent else 1)
    return div(ret, C(basis)) if basis else ret


def features(df: DataFrame, base: list[str], lags: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Lags of the base columns and the products of every two of them."""
    cols = {f"{c}_lag{n}": w.delay(C(c), n) for c in base for n in lags}
    cols |= {f"{a}_x_{b}": C(a) * C(b) for i, a in enumerate(base) for b in base[i + 1:]}
    return df.withColumns(cols)


def strict_label(df: DataFrame, n: int = 5, drawdown: float = 3.0) -> Column:
    """1 where the label is top, the close n bars on isn't under this close and
    the lows between stay within the drawdown (per cent of this close); 0 where
    the label is bottom; NULL elsewhere, a top that fails included."""
    worst = div(C("close") - w.forward_low(C("low"), n), C("close")) * 100
    good = (C("label") == 1) & (w.lead(C("close"), n) >= C("close")) & (worst < drawdown)
    return F.when(good, 1).when(C("label") == 0, 0)


#: The families of one-hot columns that a panel always has.
FAMILIES = {"cpr_vs_prev": ("CPR_Yday", ("Above", "Below", "Inside", "Overlap")), "cpr_next": ("CPR_Tmr", ("Above", "Below", "Inside", "Overlap")),
            "structure": ("Struct", ("uptrend", "downtrend", "range")), "day_type": ("DayType", ("bullish", "bearish", "inside"))}


def featurised(df: DataFrame) -> DataFrame:
    """The panel's engineered columns: lags 1 and 2 of RSI, ADX, EMA angle and
    OBV slope; complete one-hot families of FAMILIES; products and squares of
    indicators (x_*); slopes of the close and the spread of five-bar returns.
    Needs oscillators(), pivots(), structure(), balance_volume() and combos()."""
    from panelforge.operators.cleaning import one_hot

    d = df if "cpr_next" in df.columns else df.withColumn("cpr_next", C("cpr_vs_prev"))
    d = d.withColumns({f"{c}_lag{n}": w.delay(C(c), n) for c in ("rsi14", "adx14", "ema20_angle", "obv_slope") for n in (1, 2)})
    d = d.withColumns({k: v for c, (prefix, values) in FAMILIES.items() for k, v in one_hot(C(c), list(values), prefix).items()})
    past = w.pct_change(C("close")) * 100
    d = d.withColumns({"atr14_to_close_pct": div(C("atr14"), C("close")) * 100, "_one": past})
    d = d.withColumns({"_past5": w.total(C("_one"), 5), "rsi14_obv_x": C("rsi14") * C("obv_slope"), "rsi7_obv_x": C("rsi7") * C("obv_slope")})
    return d.withColumns({
        "x_rsi14_adx14": C("rsi14") * C("adx14"), "x_cprw_atr_pct": F.abs("cpr_width_pct") * C("atr14_to_close_pct"),
        "x_trend_atr_pct": F.when(C("structure") == "uptrend", 1).when(C("structure") == "downtrend", -1).otherwise(0) * C("atr14_to_close_pct"),
        "x_rsi_cross_strength": (C("rsi7") - C("rsi14")) * C("adx14"), "x_macd_nonlin": (C("macd") - C("macd_signal")) * C("rsi14") / 50,
        "x_adx_sqr": C("adx14") * C("adx14") / 100, "close_slope20": w.slope(C("close"), 20), "close_slope50": w.slope(C("close"), 50),
        "past5_spread": w.std(C("_past5"), 50, 10)}).drop("_one", "_past5")


def follow_through(ret: Column, band: float = 0.1) -> Column:
    """1 above the band, 0 below minus the band, else unknown."""
    return F.when(ret > band, 1).when(ret < -band, 0)


# --- splits: one row a date, joined back by broadcast ------------------------

def numbered_dates(df: DataFrame) -> DataFrame:
    """ts, k from 0, n: the distinct dates in order."""
    d = df.select("ts").distinct()
    o = Window.partitionBy(F.lit("dates"))
    return d.select("ts", (F.row_number().over(o.orderBy("ts")) - 1).alias("k"), F.count("*").over(o).alias("n"))


def three_way(df: DataFrame, train: float = 0.7, cal: float = 0.2, embargo: int = 5) -> DataFrame:
    """ts, part (train, cal, test) of whole days; the last `embargo` days before
    a later part belong to none."""
    d = numbered_dates(df)
    a, b = F.floor(C("n") * train), F.floor(C("n") * round(train + cal, 10))
    part = F.when(C("k") < a - embargo, "train").when((C("k") >= a) & (C("k") < b - embargo), "cal").when(C("k") >= b, "test")
    return d.select("ts", part.alias("part"))


def expanding_folds(df: DataFrame, folds: int = 5, embargo_days: int = 5) -> DataFrame:
    """fold, ts, part: training on all dates before a fold's test dates, less an
    embargo of calendar days."""
    d = numbered_dates(df)
    cuts = d.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds)))).withColumn("_a", F.floor(C("n") * C("fold") / (folds + 1))).withColumn("_b", F.floor(C("n") * (C("fold") + 1) / (folds + 1)))
    start = F.min(F.when(C("k") >= C("_a"), C("ts"))).over(Window.partitionBy("fold"))
    part = F.when((C("k") >= C("_a")) & (C("k") < C("_b")), "test").when(C("ts") < F.date_sub(start, embargo_days), "train")
    return cuts.withColumn("part", part).where("part is not null").select("fold", "ts", "part")


def purged_folds(df: DataFrame, folds: int = 5, embargo: int = 5) -> DataFrame:
    """fold, ts, part: each fold's dates are tested once, trained on the dates
    of both sides that are more than `embargo` dates away."""
    d = numbered_dates(df).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    a, b = F.floor(C("n") * C("fold") / folds), F.floor(C("n") * (C("fold") + 1) / folds)
    part = F.when((C("k") >= a) & (C("k") < b), "test").when((C("k") < a - embargo) | (C("k") >= b + embargo), "train")
    return d.withColumn("part", part).where("part is not null").select("fold", "ts", "part")


def out_of_time(df: DataFrame, share: float = 0.8, embargo: int = 0) -> DataFrame:
    """ts, oos: dates after the share of sorted dates, shifted by the embargo."""
    return numbered_dates(df).select("ts", (C("k") >= F.floor(C("n") * share) + embargo).alias("oos"))


def by_time(df: DataFrame, share: float = 0.8) -> Column:
    """True for the first share of each symbol's rows."""
    p = Window.partitionBy("symbol")
    return F.row_number().over(p.orderBy("ts")) <= F.floor(F.count("*").over(p) * share)
