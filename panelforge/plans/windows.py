"""Queries of the window primitives (W)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.functions.exprs import div, so_far
from panelforge.operators import windows as w
from panelforge.plans.sql import BARS, CUM, HOURS, MONTHS, P, USERS, ewm, r, rd, roll, xs_rank
from panelforge.sources import bars

C = F.col
BASE = ["symbol", "ts"]



def w01_lags(spark, sf):
    b = bars.supplier_days(spark, sf)
    return b.select(*BASE, w.delay(C("close"), 1).alias("lag1"), w.lead(C("close"), 5).alias("lead5"),
                    *rd(diff1=w.delta(C("close")), pct=w.pct_change(C("close")), pct5=w.pct_change(C("close"), 5)))


W01 = f"""WITH {BARS} SELECT symbol, ts, lag(close) OVER {P} AS lag1, lead(close, 5) OVER {P} AS lead5,
 round(close - lag(close) OVER {P}, 4) AS diff1, round(close / nullif(lag(close) OVER {P}, 0) - 1, 4) AS pct,
 round(close / nullif(lag(close, 5) OVER {P}, 0) - 1, 4) AS pct5 FROM bars"""


def w02_rolling(spark, sf):
    b, c = bars.supplier_days(spark, sf), C("close")
    return b.select(*BASE, *rd(mean20=w.mean(c, 20, 10), sum5=w.total(c, 5), std20=w.std(c, 20, 10)),
                    w.low(c, 50, 25).alias("min50"), w.high(c, 50, 25).alias("max50"))


W02 = f"""WITH {BARS} SELECT symbol, ts, round({roll('avg(close)', 'close', 20, 10)}, 4) AS mean20, round({roll('sum(close)', 'close', 5, 5)}, 4) AS sum5,
 round({roll('stddev_samp(close)', 'close', 20, 10)}, 4) AS std20, {roll('min(close)', 'close', 50, 25)} AS min50, {roll('max(close)', 'close', 50, 25)} AS max50 FROM bars"""


def w03_rolling_median(spark, sf):
    b = bars.supplier_days(spark, sf)
    d = b.withColumn("ret", w.pct_change(C("close"))).groupBy("ts").agg(F.avg("ret").alias("m"))
    # One row a date: a small series of its own.
    frame = Window.partitionBy(F.lit("market")).orderBy("ts").rowsBetween(-249, 0)
    return d.select("ts", *rd(median250=F.when(F.count("m").over(frame) >= 50, F.percentile(F.round("m", 8), 0.5).over(frame))))


W03 = f"""WITH {BARS}, d AS (SELECT ts, avg(ret) AS m FROM (SELECT ts, close / nullif(lag(close) OVER {P}, 0) - 1 AS ret FROM bars) GROUP BY ts)
SELECT ts, round(CASE WHEN count(m) OVER f >= 50 THEN quantile_cont(round(m, 8), 0.5) OVER f END, 4) AS median250 FROM d WINDOW f AS (ORDER BY ts ROWS BETWEEN 249 PRECEDING AND CURRENT ROW)"""


def w04_corr_w05_cov(spark, sf):
    b = bars.supplier_days(spark, sf)
    return b.select(*BASE, *rd(corr10=w.corr(C("open"), C("volume"), 10), cov5=w.cov(C("close"), C("volume"), 5, 3)))


W04 = f"""WITH {BARS} SELECT symbol, ts, CASE WHEN isnan(c) THEN NULL ELSE round(c, 4) END AS corr10, round(v, 4) AS cov5 FROM
 (SELECT *, {roll('corr(open, volume)', 'open', 10, 5)} AS c, {roll('covar_samp(close, volume)', 'close', 5, 3)} AS v FROM bars)"""


def w06_ts_rank(spark, sf):
    return bars.supplier_days(spark, sf).select(*BASE, *rd(rank20=w.ts_rank(C("volume"), 20)))


W06 = f"""WITH {BARS}, l AS (SELECT symbol, ts, volume AS x, list(volume) OVER {r(20)} AS v FROM bars)
SELECT symbol, ts, CASE WHEN len(v) >= 10 THEN round((len(list_filter(v, lambda y: y < x)) + (len(list_filter(v, lambda y: y = x)) + 1) / 2) / len(v), 4) END AS rank20 FROM l"""


def w07_expanding_rank_w08_ewm(spark, sf):
    b = bars.supplier_months(spark, sf)
    d = w.recursive(b, {"rank_all": ("rank", "volume", 20), "ema20": ("ewm", "close", w.span(20), 1), "wilder14": ("ewm", "close", 1 / 14, 14)})
    return d.select(*BASE, *rd(rank_all=C("rank_all"), ema20=C("ema20"), wilder14=C("wilder14")))


_E1, _N1 = ewm("close", w.span(20), 1)
_E2, _N2 = ewm("close", 1 / 14, 14)
W07 = f"""WITH RECURSIVE {MONTHS}, {_E1}, {_E2},
k AS (SELECT a.symbol, a.ts, count(*) AS n, sum(CASE WHEN b.volume < a.volume THEN 1 ELSE 0 END) AS lo, sum(CASE WHEN b.volume = a.volume THEN 1 ELSE 0 END) AS eq
 FROM bars a JOIN bars b ON a.symbol = b.symbol AND b.ts <= a.ts GROUP BY 1, 2)
SELECT bars.symbol, bars.ts, CASE WHEN n >= 20 THEN round((lo + (eq + 1) / 2) / n, 4) END AS rank_all, round(x.y, 4) AS ema20, CASE WHEN z.k >= 14 THEN round(z.y, 4) END AS wilder14
FROM bars JOIN k USING (symbol, ts) JOIN {_N1} x USING (symbol, ts) JOIN {_N2} z USING (symbol, ts)"""


def w09_w11_sessions(spark, sf):
    b = bars.event_hours(spark, sf).withColumn("day", F.to_date("ts"))
    s = so_far("symbol", "day")
    tp = (C("high") + C("low") + C("close")) / 3
    return b.select(*BASE, *rd(std_session=F.when(F.count("close").over(s) >= 3, F.stddev_samp("close").over(s)),
                               vwap=div(F.sum(tp * C("volume")).over(s), F.sum("volume").over(s))), F.sum("volume").over(s).alias("cum_volume"))


_S = "(PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts ROWS UNBOUNDED PRECEDING)"
W09 = f"""WITH {HOURS} SELECT symbol, ts, round(CASE WHEN count(close) OVER {_S} >= 3 THEN stddev_samp(close) OVER {_S} END, 4) AS std_session,
 round(sum((high + low + close) / 3 * volume) OVER {_S} / nullif(sum(volume) OVER {_S}, 0), 4) AS vwap, sum(volume) OVER {_S} AS cum_volume FROM bars"""


def w10_obv_w12_cummax(spark, sf):
    b = bars.supplier_days(spark, sf)
    move = F.coalesce(F.signum(w.delta(C("close"))), F.lit(0.0)) * C("volume")
    d = b.withColumn("_m", move)
    return d.select(*BASE, F.sum("_m").over(so_far("symbol")).alias("obv"),
                    F.max("high").over(Window.partitionBy("symbol", F.trunc("ts", "month")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)).alias("month_high"))


W10 = f"""WITH {BARS}, m AS (SELECT *, coalesce(sign(close - lag(close) OVER {P}), 0) * volume AS mv FROM bars)
SELECT symbol, ts, sum(mv) OVER {CUM} AS obv, max(high) OVER (PARTITION BY symbol, date_trunc('month', ts) ORDER BY ts ROWS UNBOUNDED PRECEDING) AS month_high FROM m"""


def w13_streak_w14_since(spark, sf):
    b = bars.supplier_days(spark, sf).withColumn("up", C("close") > w.delay(C("close"), 1)).withColumn("top", C("close") >= w.high(C("close"), 20, 20))
    return w.with_since(w.with_streak(b, C("up"), "streak"), C("top"), "since").select(*BASE, "streak", "since")


W13 = f"""WITH {BARS}, f AS (SELECT symbol, ts, coalesce(close > lag(close) OVER {P}, false) AS up, coalesce(close >= {roll('max(close)', 'close', 20, 20)}, false) AS top, row_number() OVER {P} AS n FROM bars)
SELECT symbol, ts, CAST(n - coalesce(max(CASE WHEN NOT up THEN n END) OVER {CUM}, 0) AS INTEGER) AS streak, CAST(coalesce(n - max(CASE WHEN top THEN n END) OVER {CUM}, 0) AS INTEGER) AS since FROM f"""


def w15_w17_slopes(spark, sf):
    b = bars.supplier_days(spark, sf)
    gap = F.when(C("volume") > 5, C("close"))
    return b.select(*BASE, *rd(full20=w.slope(C("close"), 20), head20=w.slope(C("close"), 20, 2), gaps10=w.slope(gap, 10, 5)))


W15 = f"""WITH {BARS}, f AS (SELECT symbol, ts, close, CASE WHEN volume > 5 THEN close END AS g, CAST(row_number() OVER {P} AS DOUBLE) AS n FROM bars),
 s AS (SELECT symbol, ts, {roll('regr_slope(close, n)', 'close', 20, 20)} AS a, {roll('regr_slope(close, n)', 'close', 20, 2)} AS b, {roll('regr_slope(g, CASE WHEN g IS NOT NULL THEN n END)', 'g', 10, 5)} AS c FROM f)
SELECT symbol, ts, round(a, 4) AS full20, round(b, 4) AS head20, round(c, 4) AS gaps10 FROM s"""


def w18_w20_cross(spark, sf):
    b = bars.user_days(spark, sf)
    x = C("close")
    return b.select(*BASE, *rd(rank_pct=w.xs_rank(x, "ts"), rank=w.xs_rank(C("volume"), "ts", pct=False), z=w.xs_zscore(x, "ts"), floor5=w.xs_floor(x, 0.05, "ts")),
                    F.count("*").over(Window.partitionBy("ts")).alias("names"))


W18 = f"""WITH {USERS}, q AS (SELECT ts, quantile_cont(close, 0.05) AS p5 FROM bars GROUP BY ts)
SELECT symbol, ts, round({xs_rank('close', 'ts')}, 4) AS rank_pct, round(CAST({xs_rank('volume', 'ts', False)} AS DOUBLE), 4) AS rank,
 round(coalesce((close - avg(close) OVER (PARTITION BY ts)) / nullif(stddev_samp(close) OVER (PARTITION BY ts), 0), 0), 4) AS z, round(greatest(close, p5), 4) AS floor5,
 count(*) OVER (PARTITION BY ts) AS names FROM bars JOIN q USING (ts)"""


def w21_forward_w22_zscore(spark, sf):
    b = bars.supplier_days(spark, sf)
    return b.select(*BASE, w.forward_high(C("high"), 5).alias("fwd_high5"), w.forward_low(C("low"), 5).alias("fwd_low5"), *rd(z20=w.zscore(C("close"), 20), z252=w.zscore(C("volume"), 252)))


_F = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"
_z = lambda x, n, k: f"({x} - {roll(f'avg({x})', x, n, k)}) / nullif({roll(f'stddev_samp({x})', x, n, k)}, 0)"
W21 = f"""WITH {BARS} SELECT symbol, ts, max(high) OVER {_F} AS fwd_high5, min(low) OVER {_F} AS fwd_low5, round({_z('close', 20, 10)}, 4) AS z20, round({_z('volume', 252, 63)}, 4) AS z252 FROM bars"""


def w23_slots_w24_first_w25_size(spark, sf):
    b = bars.event_hours(spark, sf).withColumn("day", F.to_date("ts"))
    prior = Window.partitionBy("symbol", F.hour("ts")).orderBy("day").rowsBetween(-20, -1)
    s = Window.partitionBy("symbol", "day").orderBy("ts")
    return b.select(*BASE, *rd(slot_mean=F.when(F.count("volume").over(prior) >= 3, F.avg("volume").over(prior)), slot_std=F.when(F.count("volume").over(prior) >= 3, F.stddev_samp("volume").over(prior))),
                    F.first("open").over(s).alias("session_open"), (F.row_number().over(s) - 1).alias("bar"), F.count("*").over(Window.partitionBy("symbol", "day")).alias("size"))


_Q = "(PARTITION BY symbol, hour(ts) ORDER BY CAST(ts AS DATE) ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
_D = "(PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts)"
W23 = f"""WITH {HOURS} SELECT symbol, ts, round(CASE WHEN count(volume) OVER {_Q} >= 3 THEN avg(volume) OVER {_Q} END, 4) AS slot_mean, round(CASE WHEN count(volume) OVER {_Q} >= 3 THEN stddev_samp(volume) OVER {_Q} END, 4) AS slot_std,
 first(open) OVER {_D} AS session_open, CAST(row_number() OVER {_D} - 1 AS INTEGER) AS bar, count(*) OVER (PARTITION BY symbol, CAST(ts AS DATE)) AS size FROM bars"""


def w26_argmax_w27_leak_w28_math(spark, sf):
    b = bars.supplier_days(spark, sf)
    x = C("close")
    return b.select(*BASE, w.argmax(x, 5).cast("int").alias("argmax5"), *rd(whole_rank=w.whole_rank(C("volume")), whole_scale=w.whole_scale(C("volume")) * 1000,
                    signed_pow=F.signum(x - 1000) * F.pow(F.abs(x - 1000) / 100, F.lit(2.0)), root=F.sqrt(x), ln=F.log(x), angle=F.degrees(F.atan(x / 100)), sigmoid=1 / (1 + F.exp(-x / 1000))))


W26 = f"""WITH {BARS}, l AS (SELECT *, list(close) OVER {r(5)} AS v FROM bars)
SELECT symbol, ts, CASE WHEN len(v) >= 5 THEN CAST(list_position(v, list_max(v)) - 1 AS INTEGER) END AS argmax5, round({xs_rank('volume', 'symbol')}, 4) AS whole_rank,
 round(volume / nullif(sum(abs(volume)) OVER (PARTITION BY symbol), 0) * 1000, 4) AS whole_scale, round(sign(close - 1000) * pow(abs(close - 1000) / 100, 2.0), 4) AS signed_pow,
 round(sqrt(close), 4) AS root, round(ln(close), 4) AS ln, round(degrees(atan(close / 100)), 4) AS angle, round(1 / (1 + exp(-close / 1000)), 4) AS sigmoid FROM l"""


def prefix_std_wide(spark, sf):
    b = bars.supplier_days(spark, sf)
    return w.prefix_std(b, "close", 252, "std252", 63).select(*BASE, F.round("std252", 2).alias("std252"))


WPS = f"""WITH {BARS} SELECT symbol, ts, round({roll('stddev_samp(close)', 'close', 252, 63)}, 2) AS std252 FROM bars"""

QUERIES = {
    "w01_lags": (w01_lags, W01), "w02_rolling": (w02_rolling, W02), "w03_rolling_median": (w03_rolling_median, W03), "w04_corr_w05_cov": (w04_corr_w05_cov, W04),
    "w06_ts_rank": (w06_ts_rank, W06), "w07_expanding_rank_w08_ewm": (w07_expanding_rank_w08_ewm, W07), "w09_w11_sessions": (w09_w11_sessions, W09),
    "w10_obv_w12_cummax": (w10_obv_w12_cummax, W10), "w13_streak_w14_since": (w13_streak_w14_since, W13), "w15_w17_slopes": (w15_w17_slopes, W15),
    "w18_w20_cross": (w18_w20_cross, W18), "w21_forward_w22_zscore": (w21_forward_w22_zscore, W21), "w23_w25_slots": (w23_slots_w24_first_w25_size, W23),
    "w26_w28_argmax_leak_math": (w26_argmax_w27_leak_w28_math, W26), "w02_prefix_std": (prefix_std_wide, WPS),
}
