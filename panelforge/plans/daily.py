"""Queries of the daily indicators (D), on daily and monthly bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators import daily as d
from panelforge.plans.sql import BARS, CUM, MONTHS, P, ewm, r, rd, roll
from panelforge.sources import bars

C = F.col
KEY = ["symbol", "ts"]


def _out(df, *same, **rounded):
    return df.select(*KEY, *same, *rd(**{k: C(v) if isinstance(v, str) else v for k, v in rounded.items()}))


def _named(df, same: str, rounded: str):
    return _out(df, *same.split(), **{k: k for k in rounded.split()})


def d01_d04_oscillators(spark, sf):
    return _named(d.oscillators(bars.supplier_months(spark, sf)), "", "ema20 ema50 macd macd_signal rsi14 atr14 pdi14 mdi14 adx14")


_sp = lambda n: 2 / (n + 1)
_e20, _n20 = ewm("close", _sp(20), 1)
_e50, _n50 = ewm("close", _sp(50), 1)
_e12, _n12 = ewm("close", _sp(12), 1)
_e26, _n26 = ewm("close", _sp(26), 1)
_MC = f"mc AS (SELECT a.symbol, a.ts, a.y - b.y AS v FROM {_n12} a JOIN {_n26} b USING (symbol, ts))"
_e9, _n9 = ewm("v", _sp(9), 1, "mc")
_MV = f"""mv AS (SELECT symbol, ts, close - lag(close) OVER {P} AS st, high - lag(high) OVER {P} AS up, lag(low) OVER {P} - low AS dn,
 greatest(high - low, abs(high - lag(close) OVER {P}), abs(low - lag(close) OVER {P})) AS tr FROM bars)"""
_et, _nt = ewm("tr", 1 / 14, 14, "mv")
_ep, _np_ = ewm("CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END", 1 / 14, 14, "mv")
_em, _nm = ewm("CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END", 1 / 14, 14, "mv")
_eg, _ng = ewm("CASE WHEN st IS NULL THEN NULL ELSE greatest(st, 0) END", 1 / 14, 14, "mv")
_el, _nl = ewm("CASE WHEN st IS NULL THEN NULL ELSE -least(st, 0) END", 1 / 14, 14, "mv")
_DI = f"""di AS (SELECT t.symbol, t.ts, t.k, t.y AS atr, 100 * p.y / nullif(t.y, 0) AS pdi, 100 * m.y / nullif(t.y, 0) AS mdi FROM {_nt} t JOIN {_np_} p USING (symbol, ts) JOIN {_nm} m USING (symbol, ts)),
dx AS (SELECT symbol, ts, CASE WHEN k >= 14 THEN 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) END AS v FROM di)"""
_ex, _nx = ewm("v", 1 / 14, 14, "dx")
D01 = f"""WITH RECURSIVE {MONTHS}, {_e20}, {_e50}, {_e12}, {_e26}, {_MC}, {_e9}, {_MV}, {_eg}, {_el}, {_et}, {_ep}, {_em}, {_DI}, {_ex}
SELECT bars.symbol, bars.ts, round(a.y, 4) AS ema20, round(b.y, 4) AS ema50, round(mc.v, 4) AS macd, round(s.y, 4) AS macd_signal,
 round(CASE WHEN g.k >= 14 THEN 100 - 100 / (1 + g.y / nullif(l.y, 0)) END, 4) AS rsi14, round(CASE WHEN di.k >= 14 THEN di.atr END, 4) AS atr14,
 round(CASE WHEN di.k >= 14 THEN di.pdi END, 4) AS pdi14, round(CASE WHEN di.k >= 14 THEN di.mdi END, 4) AS mdi14, round(CASE WHEN x.k >= 14 THEN x.y END, 4) AS adx14
FROM bars JOIN {_n20} a USING (symbol, ts) JOIN {_n50} b USING (symbol, ts) JOIN mc USING (symbol, ts) JOIN {_n9} s USING (symbol, ts)
 LEFT JOIN {_ng} g USING (symbol, ts) LEFT JOIN {_nl} l USING (symbol, ts) JOIN di USING (symbol, ts) LEFT JOIN {_nx} x USING (symbol, ts)"""


def d05_d08_pivots(spark, sf):
    return _named(d.pivots(d.money_flow(bars.supplier_days(spark, sf))), "prev_high prev_low prev_close inside_day prev_inside_day cpr_vs_prev cpr_code",
                  "cmf20 pivot bc tc support1 resistance1 support2 resistance2 cpr_width_pct")


_LAGS = f"lag(high) OVER {P} AS ph, lag(low) OVER {P} AS pl, lag(close) OVER {P} AS pc"
D05 = f"""WITH {BARS}, a AS (SELECT *, {_LAGS}, (high + low + close) / 3 AS pv, (high + low) / 2 AS bc, ((close - low) - (high - close)) / nullif(high - low, 0) * volume AS mf FROM bars),
b AS (SELECT *, 2 * pv - bc AS tc, CASE WHEN coalesce(high <= ph AND low >= pl, false) THEN 1 ELSE 0 END AS ins FROM a),
c AS (SELECT *, lag(bc) OVER {P} AS lb, lag(tc) OVER {P} AS lt, lag(ins) OVER {P} AS pins FROM b),
e AS (SELECT *, CASE WHEN lb IS NOT NULL THEN CASE WHEN bc <= lt AND tc >= lb THEN 'Inside' WHEN tc < lb THEN 'Below' WHEN bc > lt THEN 'Above' ELSE 'Overlap' END END AS rel FROM c)
SELECT symbol, ts, ph AS prev_high, pl AS prev_low, pc AS prev_close, ins AS inside_day, pins AS prev_inside_day, rel AS cpr_vs_prev,
 CASE rel WHEN 'Above' THEN 1 WHEN 'Below' THEN -1 ELSE 0 END AS cpr_code, round(sum(mf) OVER {r(20)} / nullif(sum(volume) OVER {r(20)}, 0), 4) AS cmf20,
 round(pv, 4) AS pivot, round(bc, 4) AS bc, round(tc, 4) AS tc, round(2 * pv - high, 4) AS support1, round(2 * pv - low, 4) AS resistance1,
 round(pv - (high - low), 4) AS support2, round(pv + (high - low), 4) AS resistance2, round((tc - bc) / nullif(close, 0) * 100, 4) AS cpr_width_pct FROM e"""


def d09_week_node(spark, sf):
    return _named(d.week_node(bars.supplier_days(spark, sf)), "", "week_node")


_WE = "CAST(ts AS DATE) + CAST((12 - isodow(ts)) % 7 AS INTEGER)"
D09 = f"""WITH {BARS}, a AS (SELECT symbol, ts, {_WE} AS wk, (high + low + close) / 3 AS p, volume AS v FROM bars),
j AS (SELECT a.symbol, a.ts, b.p, b.v, min(b.p) OVER q AS lo, max(b.p) OVER q AS hi FROM a JOIN a b ON a.symbol = b.symbol AND a.wk = b.wk AND b.ts <= a.ts WINDOW q AS (PARTITION BY a.symbol, a.ts)),
h AS (SELECT symbol, ts, lo, hi, CASE WHEN hi > lo THEN least(CAST(floor((p - lo) / (hi - lo) * 50) AS INTEGER), 49) ELSE 0 END AS bin, sum(v) AS v FROM j GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY v DESC, bin) AS k FROM h)
SELECT symbol, ts, round(CASE WHEN hi <= lo THEN lo ELSE lo + (hi - lo) * (2 * bin + 1) / 100 END, 4) AS week_node FROM m WHERE k = 1"""


def d10_d11_narrow_averages(spark, sf):
    return _named(d.averages(d.narrow_range(bars.supplier_days(spark, sf))), "nr7 nr_day nr_length golden", "sma5 sma20 sma50 sma200")


_nr = lambda n: f"(count(r) OVER f{n} >= {n - 1} AND r < min(r) OVER f{n})"
D10 = f"""WITH {BARS}, a AS (SELECT *, high - low AS r FROM bars), b AS (SELECT *, CASE WHEN coalesce({_nr(7)}, false) THEN 1 ELSE 0 END AS nr7,
 coalesce({', '.join(f'CASE WHEN {_nr(n)} THEN {n} END' for n in range(20, 4, -1))}) AS nr_day, row_number() OVER {P} AS n,
 {', '.join(f"{roll('avg(close)', 'close', k, k)} AS s{k}" for k in (5, 20, 50, 200))} FROM a
 WINDOW {', '.join(f'f{n} AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND 1 PRECEDING)' for n in range(20, 4, -1))})
SELECT symbol, ts, nr7, nr_day, CAST(n - coalesce(max(CASE WHEN nr7 = 0 THEN n END) OVER {CUM}, 0) AS INTEGER) AS nr_length, CASE WHEN coalesce(close > s200 AND s50 > s200, false) THEN 1 ELSE 0 END AS golden,
 round(s5, 4) AS sma5, round(s20, 4) AS sma20, round(s50, 4) AS sma50, round(s200, 4) AS sma200 FROM b"""


def d13_d15_structure(spark, sf):
    return _named(d.structure(d.pivots(bars.supplier_days(spark, sf))), "hh hl lh ll daily_trend structure day_type hh_run ll_run weekly_trend monthly_trend", "open_location")


def _pt(period: str, name: str) -> str:
    return f"""{name}m AS (SELECT symbol, {period} AS q, max(high) AS m FROM bars GROUP BY 1, 2), {name}l AS (SELECT symbol, q, lag(m) OVER (PARTITION BY symbol ORDER BY q) AS last FROM {name}m),
{name} AS (SELECT b.symbol, b.ts, CAST(coalesce(sign(max(high) OVER (PARTITION BY b.symbol, {period.replace('ts', 'b.ts')} ORDER BY b.ts ROWS UNBOUNDED PRECEDING) - last), 0) AS INTEGER) AS t
 FROM bars b JOIN {name}l x ON b.symbol = x.symbol AND x.q = {period.replace('ts', 'b.ts')})"""


D13 = f"""WITH {BARS}, {_pt(_WE, 'wt')}, {_pt("date_trunc('month', ts)", 'mt')}, a AS (SELECT *, {_LAGS}, (high + low) / 2 AS bc, 2 * (high + low + close) / 3 - (high + low) / 2 AS tc, row_number() OVER {P} AS n FROM bars),
b AS (SELECT *, CASE WHEN coalesce(high > ph, false) THEN 1 ELSE 0 END AS hh, CASE WHEN coalesce(low > pl, false) THEN 1 ELSE 0 END AS hl, CASE WHEN coalesce(high < ph, false) THEN 1 ELSE 0 END AS lh, CASE WHEN coalesce(low < pl, false) THEN 1 ELSE 0 END AS ll FROM a)
SELECT b.symbol, b.ts, hh, hl, lh, ll, CASE WHEN lh = 1 THEN -1 WHEN hh = 1 THEN 1 ELSE 0 END AS daily_trend, CASE WHEN hh = 1 AND hl = 1 THEN 'uptrend' WHEN lh = 1 AND ll = 1 THEN 'downtrend' ELSE 'range' END AS structure,
 CASE WHEN open > tc THEN 'bullish' WHEN open < bc THEN 'bearish' ELSE 'inside' END AS day_type, CAST(n - coalesce(max(CASE WHEN hh = 0 THEN n END) OVER (PARTITION BY b.symbol ORDER BY b.ts), 0) AS INTEGER) AS hh_run,
 CAST(n - coalesce(max(CASE WHEN ll = 0 THEN n END) OVER (PARTITION BY b.symbol ORDER BY b.ts), 0) AS INTEGER) AS ll_run, wt.t AS weekly_trend, mt.t AS monthly_trend, round((open - low) / nullif(high - low, 0), 4) AS open_location
FROM b JOIN wt USING (symbol, ts) JOIN mt USING (symbol, ts)"""


def d16_d20_obv_bands(spark, sf):
    return _named(d.bands(d.balance_volume(bars.supplier_days(spark, sf))), "obv obv_slope both_rising break_up20 break_down20 break_up50 break_down50 since_up20 since_down20",
                  "bb_pos bb_width vol_yz20 vol_yz50 channel20 channel50")


_b = lambda n: f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
_fl = lambda c: f"CASE WHEN coalesce({c}, false) THEN 1 ELSE 0 END"
_cl = lambda x, lo, hi: f"CASE WHEN ({x}) IS NOT NULL THEN greatest({lo}, least({hi}, {x})) END"
D16 = f"""WITH {BARS}, a AS (SELECT *, {_LAGS}, coalesce(sign(close - lag(close) OVER {P}), 0) * volume AS m, {roll('avg(close)', 'close', 20, 20)} AS mid, 4 * ({roll('stddev_samp(close)', 'close', 20, 2)}) AS wd,
 max(high) OVER {_b(20)} AS h2, min(low) OVER {_b(20)} AS l2, max(high) OVER {_b(50)} AS h5, min(low) OVER {_b(50)} AS l5, row_number() OVER {P} AS n FROM bars),
b AS (SELECT *, sum(m) OVER {CUM} AS obv, pow(ln(open / pc), 2) + 0.34 * pow(ln(close / open), 2) + 0.66 * (ln(high / open) * ln(high / close) + ln(low / open) * ln(low / close)) AS yz,
 {_fl('high > h2')} AS u2, {_fl('low < l2')} AS d2, {_fl('high > h5')} AS u5, {_fl('low < l5')} AS d5 FROM a)
SELECT symbol, ts, obv, obv - lag(obv) OVER {P} AS obv_slope, {_fl(f'close > pc AND obv > lag(obv) OVER {P}')} AS both_rising, u2 AS break_up20, d2 AS break_down20, u5 AS break_up50, d5 AS break_down50,
 CAST(coalesce(n - max(CASE WHEN u2 = 1 THEN n END) OVER {CUM}, 0) AS INTEGER) AS since_up20, CAST(coalesce(n - max(CASE WHEN d2 = 1 THEN n END) OVER {CUM}, 0) AS INTEGER) AS since_down20,
 round({_cl('(close - (mid - wd / 2)) / nullif(wd, 0)', '-5.0', '5.0')}, 4) AS bb_pos, round(wd / nullif(mid, 0), 4) AS bb_width,
 round(sqrt(greatest({roll('avg(yz)', 'yz', 20, 10)}, 0.0)), 4) AS vol_yz20, round(sqrt(greatest({roll('avg(yz)', 'yz', 50, 16)}, 0.0)), 4) AS vol_yz50,
 round({_cl('(close - l2) / nullif(h2 - l2, 0)', '-1.0', '2.0')}, 4) AS channel20, round({_cl('(close - l5) / nullif(h5 - l5, 0)', '-1.0', '2.0')}, 4) AS channel50 FROM b"""


def d21_d23_activity(spark, sf):
    return _named(d.activity(bars.supplier_days(spark, sf)), "surge20 surge50", "turnover_z20 turnover_z50 turnover_z252 range_pct gap_pct ret_5d ret_5d_spread")


_zz = lambda n: f"(t - {roll('avg(t)', 't', n, max(10, n // 4))}) / nullif({roll('stddev_samp(t)', 't', n, max(10, n // 4))}, 0)"
_su = lambda n, k: _fl(f"volume > ({roll('avg(volume)', 'volume', n, k)}) + 2 * ({roll('stddev_samp(volume)', 'volume', n, k)})")
D21 = f"""WITH {BARS}, a AS (SELECT *, close * volume AS t, (close / nullif(lag(close, 5) OVER {P}, 0) - 1) * 100 AS bk FROM bars)
SELECT symbol, ts, {_su(20, 5)} AS surge20, {_su(50, 10)} AS surge50, round({_zz(20)}, 4) AS turnover_z20, round({_zz(50)}, 4) AS turnover_z50, round({_zz(252)}, 4) AS turnover_z252, round((high - low) / nullif(close, 0) * 100, 4) AS range_pct,
 round((open - lag(close) OVER {P}) / nullif(lag(close) OVER {P}, 0) * 100, 4) AS gap_pct, round((lead(close, 5) OVER {P} / nullif(close, 0) - 1) * 100, 4) AS ret_5d, round({roll('stddev_samp(bk)', 'bk', 50, 10)}, 4) AS ret_5d_spread FROM a"""


def d24_d26_candles(spark, sf):
    return _named(d.candles(bars.supplier_days(spark, sf)), "expand", "body wick_skew slope20 slope50 mid_slope10 slope_spread")


_rs = lambda y, n: roll(f"regr_slope({y}, n)", y, n, n)
D24 = f"""WITH {BARS}, a AS (SELECT *, high - low AS g, (high + low) / 2 AS mid, CAST(row_number() OVER {P} AS DOUBLE) AS n FROM bars), b AS (SELECT *, {_rs('close', 5)} AS s5 FROM a)
SELECT symbol, ts, {_fl(f'g > lag(g) OVER {P}')} AS expand, round({_cl('(close - open) / nullif(g, 0)', '-1.0', '1.0')}, 4) AS body,
 round({_cl('((high - greatest(close, open)) - (least(close, open) - low)) / nullif(g, 0)', '-1.0', '1.0')}, 4) AS wick_skew,
 round({_rs('close', 20)}, 4) AS slope20, round({_rs('close', 50)}, 4) AS slope50, round({_rs('mid', 10)}, 4) AS mid_slope10, round({roll('stddev_samp(s5)', 's5', 20, 5)}, 4) AS slope_spread FROM b"""


def d27_weekly(spark, sf):
    return _named(d.weekly(bars.supplier_days(spark, sf)), "", "w_ret4 w_ret13 w_close_pos w_volume")


_WB = "(PARTITION BY symbol ORDER BY wk)"
D27 = f"""WITH {BARS}, a AS (SELECT *, {_WE} AS wk FROM bars), k AS (SELECT symbol, wk, arg_max(close, ts) AS c, max(high) AS h, min(low) AS l, sum(volume) AS v FROM a GROUP BY 1, 2),
g AS (SELECT symbol, wk, (c / nullif(lag(c,4) OVER {_WB}, 0) - 1) * 100 AS x1, (c / nullif(lag(c, 13) OVER {_WB}, 0) - 1) * 100 AS x2, {_cl('(c - l) / nullif(h - l, 0)', '0.0', '1.0')} AS x3,
 v / nullif(CASE WHEN count(v) OVER q >= 2 THEN avg(v) OVER q END, 0) AS x4, count(*) OVER (PARTITION BY symbol) AS n FROM k WINDOW q AS (PARTITION BY symbol ORDER BY wk ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)),
p AS (SELECT symbol, wk, lag(x1) OVER {_WB} AS x1, lag(x2) OVER {_WB} AS x2, lag(x3) OVER {_WB} AS x3, lag(x4) OVER {_WB} AS x4, n FROM g)
SELECT a.symbol, a.ts, round(CASE WHEN n >= 5 THEN x1 END, 4) AS w_ret4, round(CASE WHEN n >= 5 THEN x2 END, 4) AS w_ret13, round(CASE WHEN n >= 5 THEN x3 END, 4) AS w_close_pos, round(CASE WHEN n >= 5 THEN x4 END, 4) AS w_volume FROM a JOIN p USING (symbol, wk)"""


def d28_alphas(spark, sf):
    return _named(d.alphas(bars.supplier_days(spark, sf)), "", " ".join(f"a{i}" for i in (3, 6, 12, 13, 16, 19, 20, 23, 26, 29, 33, 35, 38, 40, 41, 44)))


def d28_alphas_plain(spark, sf):
    b = bars.supplier_days(spark, sf)
    o, h, low, c, v = (C(k) for k in ("open", "high", "low", "close", "volume"))
    w = d.w
    return b.select(*KEY, *rd(a6=-w.corr(o, v, 10), a12=F.signum(w.delta(v)) * -w.delta(c), a23=F.when(w.mean(h, 20, 10) < h, -w.delta(h, 2)).otherwise(0.0), a41=F.sqrt(h * low) - (h + low + c) / 3))


D28 = f"""WITH {BARS}, a AS (SELECT *, {roll('corr(open, volume)', 'open', 10, 5)} AS k, {roll('avg(high)', 'high', 20, 10)} AS mh FROM bars)
SELECT symbol, ts, round(CASE WHEN isnan(k) THEN NULL ELSE -k END, 4) AS a6, round(sign(volume - lag(volume) OVER {P}) * -(close - lag(close) OVER {P}), 4) AS a12,
 round(CASE WHEN mh < high THEN -(high - lag(high, 2) OVER {P}) ELSE 0.0 END, 4) AS a23, round(sqrt(high * low) - (high + low + close) / 3, 4) AS a41 FROM a"""


def d29_transforms_d12_d17(spark, sf):
    t = d.transforms(bars.supplier_days(spark, sf), "close")
    return t.select(*KEY, "close_lag1", "close_lag3", "close_lag5", *rd(diff1=C("close_diff1"), diff5=C("close_diff5"), mean10=C("close_mean10"), std10=C("close_std10"), mean20=C("close_mean20"), rank10=C("close_rank10")),
                    *[(F.weekday("ts") == k).cast("int").alias(f"dow_{k}") for k in range(5)])


D29 = f"""WITH {BARS}, a AS (SELECT *, list(close) OVER {r(10)} AS l FROM bars)
SELECT symbol, ts, lag(close) OVER {P} AS close_lag1, lag(close, 3) OVER {P} AS close_lag3, lag(close, 5) OVER {P} AS close_lag5, round(close - lag(close) OVER {P}, 4) AS diff1, round(close - lag(close, 5) OVER {P}, 4) AS diff5,
 round({roll('avg(close)', 'close', 10, 5)}, 4) AS mean10, round({roll('stddev_samp(close)', 'close', 10, 5)}, 4) AS std10, round({roll('avg(close)', 'close', 20, 10)}, 4) AS mean20,
 round(CASE WHEN len(l) >= 5 THEN (len(list_filter(l, lambda y: y < close)) + (len(list_filter(l, lambda y: y = close)) + 1) / 2) / len(l) END, 4) AS rank10,
 {', '.join(f'CAST(isodow(ts) - 1 = {k} AS INTEGER) AS dow_{k}' for k in range(5))} FROM a"""

QUERIES = {
    "d01_d04_oscillators": (d01_d04_oscillators, D01), "d05_d08_pivots": (d05_d08_pivots, D05), "d09_week_node": (d09_week_node, D09),
    "d10_d11_narrow_averages": (d10_d11_narrow_averages, D10), "d13_d15_structure": (d13_d15_structure, D13), "d16_d20_obv_bands": (d16_d20_obv_bands, D16),
    "d21_d23_activity": (d21_d23_activity, D21), "d24_d26_candles": (d24_d26_candles, D24), "d27_weekly": (d27_weekly, D27),
    "d28_alphas": (d28_alphas, None), "d28_alphas_plain": (d28_alphas_plain, D28), "d29_transforms_dow": (d29_transforms_d12_d17, D29),
}
