"""Session-aware indicators: a session is a calendar day of a symbol's bars.
Running values restart with the session and never look past the bar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.functions.exprs import clip, div, flag, series, so_far
from panelforge.operators import windows as w
from panelforge.operators.daily import volume_node

C = F.col
TYPICAL = "(high + low + close) / 3"


def sessions(df: DataFrame) -> DataFrame:
    """session, minute (of the day), slot (hour), bar (place in the session)."""
    d = df.withColumns({"session": F.to_date("ts"), "minute": F.hour("ts") * 60 + F.minute("ts"), "slot": F.hour("ts")})
    return d.withColumn("bar", F.row_number().over(Window.partitionBy("symbol", "session").orderBy("ts")) - 1)


def vwap_bands(df: DataFrame) -> DataFrame:
    """Session VWAP, deviation from it and bands of the running spread."""
    s, tp = so_far("symbol", "session"), F.expr(TYPICAL)
    d = df.withColumn("vwap", div(F.sum(tp * C("volume")).over(s), F.sum("volume").over(s)))
    d = d.withColumn("_sd", F.when(F.count("close").over(s) >= 3, F.stddev_samp("close").over(s)))
    return d.withColumns({"vwap_dev": div(C("close") - C("vwap"), C("vwap")) * 100, **{f"vwap_{n}{k}": C("vwap") + (k if n == "up" else -k) * C("_sd") for n in ("up", "down") for k in (1, 2)}}).drop("_sd")


def session_node(df: DataFrame, bins: int = 30) -> DataFrame:
    """The session's running volume node: a histogram of its bars so far."""
    s = so_far("symbol", "session")
    d = df.withColumns({"_p": F.collect_list(F.expr(TYPICAL)).over(s), "_v": F.collect_list("volume").over(s)})
    return d.withColumn("session_node", volume_node(C("_p"), C("_v"), bins)).drop("_p", "_v")


def opening_range(df: DataFrame, minutes: int, opens: int = 0) -> DataFrame:
    """High and low of the session's first minutes (from minute `opens` of the
    day), known only after them, with width, breakouts and the distances of the
    close in per cent."""
    s = Window.partitionBy("symbol", "session")
    cutoff = opens + minutes
    early, known = (C("minute") >= opens) & (C("minute") < cutoff), C("minute") >= cutoff
    hi, lo = f"or{minutes}_high", f"or{minutes}_low"
    d = df.withColumns({hi: F.when(known, F.max(F.when(early, C("high"))).over(s)), lo: F.when(known, F.min(F.when(early, C("low"))).over(s))})
    return d.withColumns({f"or{minutes}_width": div(C(hi) - C(lo), C("close")) * 100, f"or{minutes}_up": flag(C("close") > C(hi)), f"or{minutes}_down": flag(C("close") < C(lo)),
                          f"or{minutes}_from_high": div(C("close") - C(hi), C(hi)) * 100, f"or{minutes}_from_low": div(C("close") - C(lo), C(lo)) * 100})


def volatility(df: DataFrame) -> DataFrame:
    """ATR in per cent of the close, and width and place in the Bollinger bands
    of 20 bars; needs atr14 of oscillators()."""
    c, mid, sd = C("close"), w.mean(C("close"), 20), w.std(C("close"), 20)
    return df.withColumns({"atr_pct": F.when(c > 0, div(C("atr14"), c) * 100), "bb_bw": F.when(mid > 0, div(4 * sd, mid)), "bb_pctb": div(c - (mid - 2 * sd), 4 * sd)})


def flow(df: DataFrame) -> DataFrame:
    """Running on-balance volume and its least-squares slope over 20 bars."""
    d = df.withColumn("_m", F.coalesce(F.signum(w.delta(C("close"))), F.lit(0.0)) * C("volume"))
    d = d.withColumn("obv", F.sum("_m").over(so_far("symbol"))).drop("_m")
    return d.withColumn("obv_slope20", w.slope(C("obv"), 20))


def returns(df: DataFrame) -> DataFrame:
    """Bar return, range, and the gap to the last session on its first bar."""
    d = df.withColumns({"ret1": w.pct_change(C("close")) * 100, "range_pct": div(C("high") - C("low"), C("close")) * 100})
    return d.withColumn("session_gap", F.when(C("bar") == 0, div(C("open") - w.delay(C("close"), 1), w.delay(C("close"), 1)) * 100))


def relative_volume(df: DataFrame, sessions_back: int = 20) -> DataFrame:
    """Volume against earlier sessions at the same time of day."""
    p = Window.partitionBy("symbol", "slot").orderBy("session").rowsBetween(-sessions_back, -1)
    n = F.count("volume").over(p) >= 3
    m = F.when(n, F.avg("volume").over(p))
    return df.withColumns({"rvol": div(C("volume"), m), "slot_z": div(C("volume") - m, F.when(n, F.stddev_samp("volume").over(p)))})


def oscillate(df: DataFrame) -> DataFrame:
    """Money-flow index, stochastic, CCI and Williams range over bars."""
    d = df.withColumns({"_tp": F.expr(TYPICAL)})
    d = d.withColumns({"_mv": w.delta(C("_tp")), "_hi": w.high(C("high"), 14), "_lo": w.low(C("low"), 14), "_m": w.mean(C("_tp"), 20)})
    up, down = (w.total(F.when(c, C("_tp") * C("volume")).otherwise(0.0), 14) for c in (C("_mv") > 0, C("_mv") < 0))
    d = d.withColumns({"mfi14": 100 - div(F.lit(100.0), 1 + div(up, down)), "stoch_k": div(C("close") - C("_lo"), C("_hi") - C("_lo")) * 100,
                       "will_r": div(C("_hi") - C("close"), C("_hi") - C("_lo")) * -100, "_dev": F.abs(C("_tp") - C("_m"))})
    return d.withColumns({"stoch_d": w.mean(C("stoch_k"), 3), "cci20": div(C("_tp") - C("_m"), 0.015 * w.mean(C("_dev"), 20))}).drop("_tp", "_mv", "_hi", "_lo", "_m", "_dev")


def second_set(df: DataFrame, wide: int = 75, opens: int = 0) -> DataFrame:
    """The other engine's set: fractions, not per cent; a score of volume over
    the last `wide` bars whatever the time of day, known from ten values on; the
    place in the channel of the bars before, clipped to -1 and 2. Needs
    oscillators() and sessions()."""
    c, v = C("close"), F.coalesce(C("volume"), F.lit(0.0))
    first = F.first("close").over(Window.partitionBy("symbol", "session").orderBy("ts"))
    before = series().rowsBetween(-wide, -1)
    edge = lambda agg, x: F.when(F.count(x).over(before) >= 10, agg(x).over(before))
    hi, lo = edge(F.max, "high"), edge(F.min, "low")
    mean, sd = w.mean(v, wide, 10), w.std(v, wide, 10)
    band, mid = 4 * w.std(c, 20, 1), w.mean(c, 20, 1)
    d = df.withColumns({f"frac{n}": w.pct_change(c, n) for n in (1, 5, 15)})
    d = d.withColumn("_m", F.coalesce(F.signum(w.delta(c)), F.lit(0.0)) * v)
    d = d.withColumns({
        "frac_std15": w.std(C("frac1"), 15, 5), "ema20_angle": F.degrees(F.atan(div(w.delta(C("ema20")), w.delay(C("ema20"), 1)))), "macd_hist": C("macd") - C("macd_signal"),
        "atr_pct": div(C("atr14"), c) * 100, "band_pos": clip(div(c - (mid - band / 2), band), -5, 5), "band_width": div(band, mid),
        "volume_z": div(v - mean, sd), "volume_surge": flag(v > mean + 2 * sd), "obv": F.sum("_m").over(so_far("symbol")), "wide_pos": clip(div(c - lo, hi - lo), -1, 2),
        "minutes_open": F.greatest(C("minute") - opens, F.lit(0)), "since_open": div(c, first) - 1})
    return d.withColumn("obv_step", w.delta(C("obv"))).drop("_m")
