"""Queries of the session indicators (I), on hourly bars of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators import intraday as i
from panelforge.operators.daily import oscillators
from panelforge.plans.sql import CUM, HOURS, P, rd, roll
from panelforge.plans.sql import oscillators as oscillator_ctes
from panelforge.sources import bars

C = F.col


def _b(spark, sf):
    return i.sessions(bars.event_hours(spark, sf))


def _out(df, same, rounded):
    return df.select("symbol", "ts", *same.split(), *rd(**{k: C(k) for k in rounded.split()}))


def i01_i03_vwap(spark, sf):
    return _out(i.vwap_bands(_b(spark, sf)), "session minute slot bar", "vwap vwap_dev vwap_up1 vwap_up2 vwap_down1 vwap_down2")


_S = "(PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts ROWS UNBOUNDED PRECEDING)"
_W = "(PARTITION BY symbol, CAST(ts AS DATE))"
_BASE = f"{HOURS}, s AS (SELECT *, CAST(ts AS DATE) AS session, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS minute, CAST(hour(ts) AS INTEGER) AS slot, CAST(row_number() OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts) - 1 AS INTEGER) AS bar, (high + low + close) / 3 AS tp FROM bars)"
I01 = f"""WITH {_BASE}, v AS (SELECT *, sum(tp * volume) OVER {_S} / nullif(sum(volume) OVER {_S}, 0) AS vw, CASE WHEN count(close) OVER {_S} >= 3 THEN stddev_samp(close) OVER {_S} END AS sd FROM s)
SELECT symbol, ts, session, minute, slot, bar, round(vw, 4) AS vwap, round((close - vw) / nullif(vw, 0) * 100, 4) AS vwap_dev, round(vw + sd, 4) AS vwap_up1, round(vw + 2 * sd, 4) AS vwap_up2, round(vw - sd, 4) AS vwap_down1, round(vw - 2 * sd, 4) AS vwap_down2 FROM v"""


def i04_session_node(spark, sf):
    return _out(i.session_node(_b(spark, sf)), "", "session_node")


I04 = f"""WITH {_BASE}, j AS (SELECT a.symbol, a.ts, b.tp AS p, b.volume AS v, min(b.tp) OVER q AS lo, max(b.tp) OVER q AS hi FROM s a JOIN s b ON a.symbol = b.symbol AND a.session = b.session AND b.ts <= a.ts WINDOW q AS (PARTITION BY a.symbol, a.ts)),
h AS (SELECT symbol, ts, lo, hi, CASE WHEN hi > lo THEN least(CAST(floor((p - lo) / (hi - lo) * 30) AS INTEGER), 29) ELSE 0 END AS bin, sum(v) AS v FROM j GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY v DESC, bin) AS k FROM h)
SELECT symbol, ts, round(CASE WHEN hi <= lo THEN lo ELSE lo + (hi - lo) * (2 * bin + 1) / 60 END, 4) AS session_node FROM m WHERE k = 1"""


_OR = ("high", "low", "up", "down")


def i05_opening_range(spark, sf):
    d = i.opening_range(i.opening_range(_b(spark, sf), 60), 360, 60)
    return _out(d, " ".join(f"or{n}_{k}" for n in (60, 360) for k in _OR), " ".join(f"or{n}_{k}" for n in (60, 360) for k in ("width", "from_high", "from_low")))


def _or(n, opens):
    early = f"CASE WHEN minute >= {opens} AND minute < {opens + n} THEN"
    return f"CASE WHEN minute >= {opens + n} THEN max({early} high END) OVER {_W} END AS or{n}_high, CASE WHEN minute >= {opens + n} THEN min({early} low END) OVER {_W} END AS or{n}_low"


def _or2(n):
    hi, lo = f"or{n}_high", f"or{n}_low"
    return (f"{hi}, {lo}, CASE WHEN coalesce(close > {hi}, false) THEN 1 ELSE 0 END AS or{n}_up, CASE WHEN coalesce(close < {lo}, false) THEN 1 ELSE 0 END AS or{n}_down, "
            f"round(({hi} - {lo}) / nullif(close, 0) * 100, 4) AS or{n}_width, round((close - {hi}) / nullif({hi}, 0) * 100, 4) AS or{n}_from_high, round((close - {lo}) / nullif({lo}, 0) * 100, 4) AS or{n}_from_low")


I05 = f"WITH {_BASE}, o AS (SELECT *, {_or(60, 0)}, {_or(360, 60)} FROM s) SELECT symbol, ts, {_or2(60)}, {_or2(360)} FROM o"


def i06_oscillators(spark, sf):
    return _out(oscillators(bars.event_hours(spark, sf)), "", "ema20 ema50 ema100 macd macd_signal rsi7 rsi14 atr14 adx14")


I06 = f"""WITH {HOURS}, {oscillator_ctes()} SELECT symbol, ts, {', '.join(f'round({k}, 4) AS {k}' for k in 'ema20 ema50 ema100 macd macd_signal rsi7 rsi14 atr14 adx14'.split())} FROM osc"""


def i07_i09_returns_volume(spark, sf):
    d = i.volatility(i.sessions(oscillators(bars.event_hours(spark, sf))))
    return _out(i.relative_volume(i.returns(d)), "", "ret1 range_pct session_gap rvol slot_z atr_pct bb_bw bb_pctb")


_Q = "(PARTITION BY symbol, slot ORDER BY session ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
_LC = f"lag(close) OVER {P}"
I07 = f"""WITH {_BASE}, {oscillator_ctes()}, m AS (SELECT s.*, atr14, {roll('avg(close)', 'close', 20, 20).replace('symbol', 's.symbol').replace('ts R', 's.ts R').replace('(close)', '(s.close)')} AS mid, {roll('stddev_samp(close)', 'close', 20, 20).replace('symbol', 's.symbol').replace('ts R', 's.ts R').replace('(close)', '(s.close)')} AS sd FROM s JOIN (SELECT symbol, ts, atr14 FROM osc) o USING (symbol, ts)), m2 AS (SELECT *, CASE WHEN count(volume) OVER {_Q} >= 3 THEN avg(volume) OVER {_Q} END AS mv, CASE WHEN count(volume) OVER {_Q} >= 3 THEN stddev_samp(volume) OVER {_Q} END AS sv FROM m)
SELECT symbol, ts, round(CASE WHEN close > 0 THEN atr14 / close * 100 END, 4) AS atr_pct, round(CASE WHEN mid > 0 THEN 4 * sd / mid END, 4) AS bb_bw, round((close - (mid - 2 * sd)) / nullif(4 * sd, 0), 4) AS bb_pctb, round((close / nullif({_LC}, 0) - 1) * 100, 4) AS ret1, round((high - low) / nullif(close, 0) * 100, 4) AS range_pct, round(CASE WHEN bar = 0 THEN (open - {_LC}) / nullif({_LC}, 0) * 100 END, 4) AS session_gap,
 round(volume / nullif(mv, 0), 4) AS rvol, round((volume - mv) / nullif(sv, 0), 4) AS slot_z FROM m2"""


def i10_i11_oscillate(spark, sf):
    return _out(i.flow(i.oscillate(_b(spark, sf))), "obv", "mfi14 stoch_k stoch_d will_r cci20 obv_slope20")


_tot = lambda c: roll(f"sum(CASE WHEN {c} THEN tp * volume ELSE 0.0 END)", "tp", 14, 14)
I10 = f"""WITH {_BASE}, a AS (SELECT *, tp - lag(tp) OVER {P} AS mv, {roll('max(high)', 'high', 14, 14)} AS hi, {roll('min(low)', 'low', 14, 14)} AS lo, {roll('avg(tp)', 'tp', 20, 20)} AS m FROM s),
b AS (SELECT *, (close - lo) / nullif(hi - lo, 0) * 100 AS sk, abs(tp - m) AS dev, {_tot('mv > 0')} AS up, {_tot('mv < 0')} AS dn, coalesce(sign(close - lag(close) OVER {P}), 0) * volume AS om, CAST(row_number() OVER {P} AS DOUBLE) AS rn FROM a), c AS (SELECT *, sum(om) OVER {CUM} AS obv FROM b)
SELECT symbol, ts, obv, round({roll('regr_slope(obv, rn)', 'obv', 20, 20)}, 4) AS obv_slope20, round(100 - 100 / nullif(1 + up / nullif(dn, 0), 0), 4) AS mfi14, round(sk, 4) AS stoch_k, round({roll('avg(sk)', 'sk', 3, 3)}, 4) AS stoch_d, round((hi - close) / nullif(hi - lo, 0) * -100, 4) AS will_r,
 round((tp - m) / nullif(0.015 * ({roll('avg(dev)', 'dev', 20, 20)}), 0), 4) AS cci20 FROM c"""


_SECOND = ("frac1", "frac5", "frac15", "frac_std15", "ema20_angle", "macd_hist", "atr_pct", "band_pos", "band_width", "volume_z", "wide_pos", "since_open")


def i12_second_set(spark, sf):
    d = i.second_set(i.sessions(oscillators(bars.event_hours(spark, sf))), opens=120)
    return _out(d, "minutes_open volume_surge obv obv_step", " ".join(_SECOND))


_B = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN 75 PRECEDING AND 1 PRECEDING)"
_fr = lambda n: f"close / nullif(lag(close, {n}) OVER {P}, 0) - 1 AS frac{n}"
I12 = f"""WITH {_BASE}, {oscillator_ctes()}, a AS (SELECT s.minute, s.session, o.*, CASE WHEN count(o.high) OVER w >= 10 THEN max(o.high) OVER w END AS hi, CASE WHEN count(o.low) OVER w >= 10 THEN min(o.low) OVER w END AS lo,
 coalesce(sign(o.close - lag(o.close) OVER q), 0) * o.volume AS om FROM s JOIN osc o ON s.symbol = o.symbol AND s.ts = o.ts WINDOW w AS (PARTITION BY o.symbol ORDER BY o.ts ROWS BETWEEN 75 PRECEDING AND 1 PRECEDING), q AS (PARTITION BY o.symbol ORDER BY o.ts)),
b AS (SELECT *, {_fr(1)}, {_fr(5)}, {_fr(15)}, sum(om) OVER {CUM} AS obv, {roll('avg(close)', 'close', 20, 1)} AS mid, {roll('stddev_samp(close)', 'close', 20, 2)} AS sd, {roll('avg(volume)', 'volume', 75, 10)} AS vm, {roll('stddev_samp(volume)', 'volume', 75, 10)} AS vs FROM a)
SELECT symbol, ts, greatest(minute - 120, 0) AS minutes_open, CASE WHEN coalesce(volume > vm + 2 * vs, false) THEN 1 ELSE 0 END AS volume_surge, obv, obv - lag(obv) OVER {P} AS obv_step,
 round(frac1, 4) AS frac1, round(frac5, 4) AS frac5, round(frac15, 4) AS frac15, round({roll('stddev_samp(frac1)', 'frac1', 15, 5)}, 4) AS frac_std15,
 round(degrees(atan((ema20 - lag(ema20) OVER {P}) / nullif(lag(ema20) OVER {P}, 0))), 4) AS ema20_angle, round(macd - macd_signal, 4) AS macd_hist, round(atr14 / nullif(close, 0) * 100, 4) AS atr_pct,
 round(greatest(-5.0, least(5.0, (close - (mid - 2 * sd)) / nullif(4 * sd, 0))) + CASE WHEN sd > 0 THEN 0 END, 4) AS band_pos, round(4 * sd / nullif(mid, 0), 4) AS band_width, round((volume - vm) / nullif(vs, 0), 4) AS volume_z,
 round(greatest(-1.0, least(2.0, (close - lo) / nullif(hi - lo, 0))) + CASE WHEN hi > lo THEN 0 END, 4) AS wide_pos, round(close / nullif(first(close) OVER {_S}, 0) - 1, 4) AS since_open FROM b"""

QUERIES = {
    "i01_i03_vwap": (i01_i03_vwap, I01), "i04_session_node": (i04_session_node, I04), "i05_opening_range": (i05_opening_range, I05), "i06_oscillators": (i06_oscillators, I06),
    "i07_i09_returns_volume": (i07_i09_returns_volume, I07), "i10_i11_oscillate": (i10_i11_oscillate, I10), "i12_second_set": (i12_second_set, I12),
}
