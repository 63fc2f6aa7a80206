"""Queries of labels (L), scoring (M) and backtests (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions import stats
from panelforge.functions.exprs import div
from panelforge.operators import aggregates as agg
from panelforge.operators import backtest as b
from panelforge.operators import candidates as cand
from panelforge.operators import daily
from panelforge.operators import labels as la
from panelforge.operators import scoring as s
from panelforge.operators import windows as w
from panelforge.plans.sql import BARS, MONTHS, P, USERS, normal_cdf, oscillators, r, rank_bucket, rd, roll, xs_rank
from panelforge.sources import bars

C = F.col


def l01_forward(spark, sf):
    d = la.forward(bars.supplier_days(spark, sf))
    return d.select("symbol", "ts", *rd(**{k: C(k) for k in ("ret_1d_cc", "ret_5d_cc", "ret_3d_oc", "fwd_mfe5", "fwd_mae5")}))


_ld = lambda c, n: f"lead({c}, {n}) OVER {P}"
_fw = lambda a, c, n: f"{a}({c}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)"
L01 = f"""WITH {BARS} SELECT symbol, ts,
 round(({_ld('close', 1)} / nullif(close, 0) - 1) * 100, 4) AS ret_1d_cc, round(({_ld('close', 5)} / nullif(close, 0) - 1) * 100, 4) AS ret_5d_cc, round(({_ld('close', 3)} / nullif({_ld('open', 1)}, 0) - 1) * 100, 4) AS ret_3d_oc,
 round(({_fw('max', 'high', 5)} / nullif(close, 0) - 1) * 100, 4) AS fwd_mfe5, round(({_fw('min', 'low', 5)} / nullif(close, 0) - 1) * 100, 4) AS fwd_mae5 FROM bars"""


def l03_bias(spark, sf):
    d = la.bias(daily.pivots(daily.oscillators(bars.supplier_months(spark, sf))))
    return d.select("symbol", "ts", *rd(long_score=C("long_score"), short_score=C("short_score")))


L03 = f"""WITH {MONTHS}, {oscillators()}, p AS (SELECT *, CASE WHEN atr14 / nullif(close, 0) * 100 > 4 THEN 0.5 ELSE 0 END
 + CASE WHEN abs((2 * (high + low + close) / 3 - (high + low)) / nullif(close, 0) * 100) > 1 THEN 0.3 ELSE 0 END AS pen FROM osc)
SELECT symbol, ts, round(CASE WHEN rsi14 BETWEEN 50 AND 70 THEN 1.0 ELSE 0.0 END - pen, 4) AS long_score, round(CASE WHEN rsi14 < 45 THEN 1.0 ELSE 0.0 END - pen, 4) AS short_score FROM p"""


def l04_market_regime(spark, sf):
    return la.market_regime(bars.supplier_days(spark, sf)).select("ts", "high_vol", *rd(trend=C("trend"), dispersion=C("dispersion")))


_before = lambda n: f"(ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
L04 = f"""WITH {BARS}, r AS (SELECT ts, (close / nullif(lag(close) OVER {P}, 0) - 1) * 100 AS r FROM bars), d AS (SELECT ts, avg(r) AS m, stddev_samp(r) AS s FROM r GROUP BY ts),
e AS (SELECT ts, CASE WHEN count(m) OVER {_before(200)} >= 50 THEN avg(m) OVER {_before(200)} END AS trend, lag(s) OVER (ORDER BY ts) AS dispersion,
 CASE WHEN count(s) OVER {_before(250)} >= 50 THEN quantile_cont(s, 0.5) OVER {_before(250)} END AS md FROM d)
SELECT ts, CASE WHEN coalesce(dispersion > md, false) THEN 1 ELSE 0 END AS high_vol, round(trend, 4) AS trend, round(dispersion, 4) AS dispersion FROM e"""

_REGIME = ("regime_dist_sma200", "regime_adx", "regime_dist_x_adx", "regime_bull_soft", "regime_trend_soft")


def l05_stock_regime(spark, sf):
    d = la.stock_regime(daily.averages(daily.oscillators(bars.supplier_days(spark, sf))))
    return d.select("symbol", "ts", "regime", "regime_lag", *rd(**{k: C(k) for k in _REGIME}))


L05 = f"""WITH {BARS}, {oscillators()}, a AS (SELECT *, {roll('avg(close)', 'close', 200, 200)} AS sma FROM osc),
b AS (SELECT *, close / nullif(sma, 0) - 1 AS d, CASE WHEN close > sma THEN 'bull' ELSE 'bear' END || CASE WHEN adx14 < 20 THEN '_range' ELSE '_trend' END AS regime FROM a)
SELECT symbol, ts, regime, coalesce(lag(regime) OVER {P}, 'bull_trend') AS regime_lag, round(d, 4) AS regime_dist_sma200, round(adx14, 4) AS regime_adx, round(d * adx14, 4) AS regime_dist_x_adx,
 round(1 / (1 + exp(-20 * d)), 4) AS regime_bull_soft, round(1 / (1 + exp((22.5 - adx14) / 5)), 4) AS regime_trend_soft FROM b"""


def l06_l10_target(spark, sf):
    d = la.scaled_target(la.forward(bars.supplier_months(spark, sf), (3,)), "ret_3d_oc", 6)
    d = d.withColumn("strict", la.strict_label(d, 3, 30.0))
    return d.select("symbol", "ts", "label", "strict", la.follow_through(C("ret_3d_oc")).alias("follow"), *rd(scaled=C("fwd_scaled"), rank=C("fwd_rank")))


_TG = f"""t0 AS (SELECT *, ({_ld('close', 3)} / nullif({_ld('open', 1)}, 0) - 1) * 100 AS ret, (close / nullif(lag(close) OVER {P}, 0) - 1) * 100 AS one FROM bars),
t1 AS (SELECT *, coalesce({roll('stddev_samp(one)', 'one', 6, 3)}, (high - low) / nullif(close, 0) * 100) AS v0 FROM t0), t2 AS (SELECT *, CASE WHEN v0 > 0 THEN v0 END AS v1 FROM t1),
t3 AS (SELECT *, greatest(v1, quantile_cont(v1, 0.05) OVER (PARTITION BY ts)) AS v FROM t2), t4 AS (SELECT *, CASE WHEN v1 IS NOT NULL THEN ret / nullif(v, 0) END AS sc FROM t3),
t5 AS (SELECT *, {xs_rank('sc', 'ts')} AS rk FROM t4), t6 AS (SELECT *, CASE WHEN rk >= 0.8 THEN 1 WHEN rk <= 0.2 THEN 0 END AS label FROM t5)"""
L06 = f"""WITH {MONTHS}, {_TG} SELECT symbol, ts, label, CASE WHEN label = 1 AND {_ld('close', 3)} >= close AND (close - {_fw('min', 'low', 3)}) / nullif(close, 0) * 100 < 30.0 THEN 1 WHEN label = 0 THEN 0 END AS strict,
 CASE WHEN ret > 0.1 THEN 1 WHEN ret < -0.1 THEN 0 END AS follow, round(sc, 4) AS scaled, round(rk, 4) AS rank FROM t6"""


def l12_l17_splits(spark, sf):
    d = bars.user_days(spark, sf)
    parts = [la.three_way(d, embargo=2).select("ts", F.lit("three").alias("kind"), F.lit(0).alias("fold"), F.coalesce("part", F.lit("none")).alias("part")),
             la.expanding_folds(d, 3, 2).select("ts", F.lit("expanding").alias("kind"), "fold", "part"), la.purged_folds(d, 4, 2).select("ts", F.lit("purged").alias("kind"), "fold", "part"),
             la.out_of_time(d, 0.8, 1).select("ts", F.lit("oot").alias("kind"), F.lit(0).alias("fold"), F.when(C("oos"), "test").otherwise("train").alias("part"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


L12 = f"""WITH {USERS}, d AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM bars)),
e AS (SELECT d.*, f, floor(n * f / 4) AS a, floor(n * (f + 1) / 4) AS b FROM d, (VALUES (1), (2), (3)) t(f)), e2 AS (SELECT *, min(CASE WHEN k >= a THEN ts END) OVER (PARTITION BY f) AS st FROM e),
g AS (SELECT d.*, f, floor(n * f / 4) AS a, floor(n * (f + 1) / 4) AS b FROM d, (VALUES (0), (1), (2), (3)) t(f)),
u AS (SELECT ts, 'three' AS kind, 0 AS fold, CASE WHEN k < floor(n * 0.7) - 2 THEN 'train' WHEN k >= floor(n * 0.7) AND k < floor(n * 0.9) - 2 THEN 'cal' WHEN k >= floor(n * 0.9) THEN 'test' ELSE 'none' END AS part FROM d
 UNION ALL SELECT ts, 'expanding', f, CASE WHEN k >= a AND k < b THEN 'test' WHEN ts < st - 2 THEN 'train' END FROM e2 UNION ALL SELECT ts, 'purged', f, CASE WHEN k >= a AND k < b THEN 'test' WHEN k < a - 2 OR k >= b + 2 THEN 'train' END FROM g
 UNION ALL SELECT ts, 'oot', 0, CASE WHEN k >= floor(n * 0.8) + 1 THEN 'test' ELSE 'train' END FROM d) SELECT * FROM u WHERE part IS NOT NULL"""


def _features(spark, sf):
    """Users' days with three features and the next change as outcome."""
    d = bars.user_days(spark, sf)
    return d.withColumns({"level": C("close"), "busy": C("volume"), "spread": C("high") - C("low"), "y": w.lead(C("close"), 1) - C("close"), "day": F.when(F.dayofmonth("ts") % 2 == 0, "even").otherwise("odd")})


def _long(spark, sf):
    return s.long_form(_features(spark, sf).withColumns({c: C(c).cast("double") for c in ("level", "busy", "spread")}), ["level", "busy", "spread"], ["symbol", "ts", "y", "day"])


_LONG = f"""{USERS}, fe AS (SELECT *, high - low AS spread, lead(close) OVER {P} - close AS y, CASE WHEN day(ts) % 2 = 0 THEN 'even' ELSE 'odd' END AS day FROM bars),
lg AS (SELECT 'level' AS feature, symbol, ts, y, day, close AS x FROM fe UNION ALL SELECT 'busy', symbol, ts, y, day, volume FROM fe UNION ALL SELECT 'spread', symbol, ts, y, day, spread FROM fe)"""


def _ic(keys: str, source: str = "lg") -> str:
    rk = lambda c: f"rank() OVER (PARTITION BY {keys} ORDER BY {c}) + (count(*) OVER (PARTITION BY {keys}, {c}) - 1) / 2"
    return f"""rk AS (SELECT *, {rk('x')} AS a, {rk('y')} AS b FROM {source} WHERE x IS NOT NULL AND y IS NOT NULL), i0 AS (SELECT {keys}, count(*) AS names, corr(a, b) AS ic FROM rk GROUP BY {keys}),
ic AS (SELECT {keys}, names, CASE WHEN names >= 30 AND NOT isnan(ic) THEN ic END AS ic FROM i0)"""


def m01_daily_ic(spark, sf):
    return s.daily_ic(_long(spark, sf), "y", 30).select("feature", "ts", "names", *rd(ic=C("ic")))


M01 = f"WITH {_LONG}, {_ic('feature, ts')} SELECT feature, ts, names, round(ic, 4) AS ic FROM ic"


def m02_pooled_m04_summary(spark, sf):
    lg = _long(spark, sf)
    d = s.summary(s.daily_ic(lg, "y", 30)).join(s.pooled(lg, "y").withColumnRenamed("ic", "pool"), "feature")
    return d.select("feature", "n", *rd(mean=C("mean"), std=C("std"), positive=C("positive"), t=C("t"), pooled=C("pool")))


_rk2 = lambda c: f"rank() OVER (PARTITION BY feature ORDER BY {c}) + (count(*) OVER (PARTITION BY feature, {c}) - 1) / 2"
M02 = f"""WITH {_LONG}, {_ic('feature, ts')}, pr AS (SELECT feature, {_rk2('x')} AS a, {_rk2('y')} AS b FROM lg WHERE x IS NOT NULL AND y IS NOT NULL), pl AS (SELECT feature, corr(a, b) AS p FROM pr GROUP BY 1),
sm AS (SELECT feature, count(*) AS n, avg(ic) AS m, stddev_samp(ic) AS s, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS ps FROM ic WHERE ic IS NOT NULL GROUP BY 1)
SELECT feature, n, round(m, 4) AS mean, round(s, 4) AS std, round(ps, 4) AS positive, round(m / nullif(s / sqrt(n), 0), 4) AS t, round(p, 4) AS pooled FROM sm JOIN pl USING (feature)"""


def m03_newey_west(spark, sf):
    return s.newey_west(s.daily_ic(_long(spark, sf), "y", 30), "ic", 3, "feature").select("feature", "n", *rd(mean=C("mean"), t=C("t")))


_g = lambda k: f"sum(e * lag_{k})"
M03 = f"""WITH {_LONG}, {_ic('feature, ts')}, e0 AS (SELECT feature, ts, ic, ic - avg(ic) OVER (PARTITION BY feature) AS e FROM ic WHERE ic IS NOT NULL),
e1 AS (SELECT *, {', '.join(f'lag(e, {k}) OVER (PARTITION BY feature ORDER BY ts) AS lag_{k}' for k in (1, 2, 3))} FROM e0),
v AS (SELECT feature, count(*) AS n, avg(ic) AS m, sum(e * e) / count(*) + {' + '.join(f'2 * (1 - {k} / 4) * coalesce(sum(e * lag_{k}), 0) / count(*)' for k in (1, 2, 3))} AS v FROM e1 GROUP BY 1)
SELECT feature, n, round(m, 4) AS mean, round(CASE WHEN v > 0 THEN m / sqrt(v / n) END, 4) AS t FROM v"""


def m10_fold_signs_m15_walk(spark, sf):
    ic = s.daily_ic(_long(spark, sf), "y", 30)
    return s.fold_signs(ic, 4, 1).join(s.walk_forward(ic, 10, 3), "feature").select("feature", "windows", *rd(agree=C("agree"), positive=C("positive")))


M10 = f"""WITH {_LONG}, {_ic('feature, ts')}, a AS (SELECT feature, ts, ic, row_number() OVER (PARTITION BY feature ORDER BY ts) - 1 AS k, count(*) OVER (PARTITION BY feature) AS n, avg(ic) OVER (PARTITION BY feature) AS m FROM ic WHERE ic IS NOT NULL),
f AS (SELECT *, CAST(CASE WHEN k < (n % 4) * (floor(n / 4) + 1) THEN floor(k / (floor(n / 4) + 1)) ELSE n % 4 + floor((k - (n % 4) * (floor(n / 4) + 1)) / greatest(floor(n / 4), 1)) END AS INTEGER) AS f FROM a),
h AS (SELECT *, row_number() OVER (PARTITION BY feature, f ORDER BY ts) AS i FROM f), fm AS (SELECT feature, f, avg(ic) AS c, any_value(m) AS m FROM h WHERE f = 0 OR i > 1 GROUP BY 1, 2),
ag AS (SELECT feature, avg(CASE WHEN sign(c) = sign(m) THEN 1.0 ELSE 0.0 END) AS agree FROM fm GROUP BY 1),
wn AS (SELECT a.feature, w.s, avg(ic) AS m FROM a JOIN (SELECT range * 3 AS s FROM range(0, 1000)) w ON a.k >= w.s AND a.k < w.s + 10 AND w.s + 10 <= a.n GROUP BY 1, 2)
SELECT feature, count(*) AS windows, round(any_value(agree), 4) AS agree, round(avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END), 4) AS positive FROM wn JOIN ag USING (feature) GROUP BY feature"""


def m11_long_short_m09_drawdown(spark, sf):
    d = _features(spark, sf).withColumn("y", C("y") / 1000)
    return s.long_short(d, "level", "y", 2, 5, 50, 0.001).select("ts", "names", *rd(**{k: C(k) for k in ("gross", "turnover", "net", "equity", "drawdown")}))


M11 = f"""WITH {_LONG}, a AS (SELECT ts, symbol, close AS x, y / 1000 AS y FROM fe WHERE y IS NOT NULL), n AS (SELECT ts, count(*) AS names FROM a GROUP BY 1 HAVING count(*) >= 50), k AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS k FROM n),
r AS (SELECT a.*, k.names, row_number() OVER (PARTITION BY ts ORDER BY x, symbol) AS r FROM a JOIN k USING (ts) WHERE k.k % 2 = 0),
b AS (SELECT *, {rank_bucket(5, 'names', 'r')} AS b FROM r),
g AS (SELECT ts, names, avg(CASE WHEN b = 5 THEN y END) - avg(CASE WHEN b = 1 THEN y END) AS gross, list(symbol) FILTER (b = 5) AS up, list(symbol) FILTER (b = 1) AS dn FROM b GROUP BY 1, 2),
t AS (SELECT *, coalesce(((1 - len(list_intersect(up, lag(up) OVER (ORDER BY ts))) / len(up)) + (1 - len(list_intersect(dn, lag(dn) OVER (ORDER BY ts))) / len(dn))) / 2, 1.0) AS turnover FROM g),
q AS (SELECT *, gross - turnover * 0.001 AS net, exp(sum(ln(greatest(1 + gross - turnover * 0.001, 1e-9))) OVER (ORDER BY ts)) AS equity FROM t)
SELECT ts, names, round(gross, 4) AS gross, round(turnover, 4) AS turnover, round(net, 4) AS net, round(equity, 4) AS equity, round(equity / greatest(max(equity) OVER (ORDER BY ts), 1.0) - 1, 4) AS drawdown FROM q"""


def m21_profile(spark, sf):
    return s.profile(_features(spark, sf), "level", "y", 10).select("bucket", "n", *rd(mean=C("mean")))


M21 = f"""WITH {_LONG}, r AS (SELECT ts, y, row_number() OVER (PARTITION BY ts ORDER BY close, symbol) AS r, count(*) OVER (PARTITION BY ts) AS n FROM fe WHERE y IS NOT NULL)
SELECT {rank_bucket(10, 'n', 'r')} AS bucket, count(*) AS n, round(avg(y), 4) AS mean FROM r GROUP BY 1"""


def m22_by_group_m23_trailing(spark, sf):
    return s.by_group(_long(spark, sf), "y", "day", 30).select("feature", "group", "dates", *rd(mean=C("mean")))


M22 = f"""WITH {_LONG}, l2 AS (SELECT feature, 'ALL' AS grp, symbol, ts, x, y FROM lg UNION ALL SELECT feature, day, symbol, ts, x, y FROM lg), {_ic('feature, grp, ts', 'l2')}
SELECT feature, grp AS "group", count(*) AS dates, round(avg(ic), 4) AS mean FROM ic WHERE ic IS NOT NULL GROUP BY 1, 2"""


def m13_strategies(spark, sf):
    d = _features(spark, sf)
    g = s.generate(d.withColumns({c: C(c).cast("double") for c in ("level", "busy", "spread")}), ["level", "busy", "spread"], C("day") == "even")
    lg = g.join(d.select("symbol", "ts", "y"), ["symbol", "ts"]).withColumnRenamed("strategy", "feature")
    ic = s.daily_ic(lg, "y", 30)
    nw = s.newey_west(ic, "ic", 3, "feature").join(s.fold_signs(ic, 4, 1), "feature")
    return nw.select(C("feature").alias("strategy"), "n", *rd(mean=C("mean"), t=C("t"), agree=C("agree")))


_GEN = [(f"single:{a}", a) for a in ("level", "busy", "spread")]
_GEN += [x for a, c in (("level", "busy"), ("level", "spread"), ("busy", "spread")) for x in
         ((f"product:{a}*{c}", f"{a} * {c}"), (f"agree:{a}&{c}", f"CASE WHEN sign({a}) = sign({c}) THEN {a} + {c} ELSE 0.0 END"))]
_GEN += [(f"gate:{a}", f"CASE WHEN day = 'even' THEN {a} END") for a in ("level", "busy", "spread")] + [("mean:all", "(level + busy + spread) / 3")]
_zs = lambda x: f"coalesce(({x} - avg({x}) OVER (PARTITION BY ts)) / nullif(stddev_samp({x}) OVER (PARTITION BY ts), 0), 0)"
_gl = lambda k: f"sum(e * lag_{k})"


def _newey(source: str) -> str:
    """CTEs up to nw (feature, n, m, t) and ag (feature, agree) of ic."""
    return f"""e0 AS (SELECT feature, ts, ic, ic - avg(ic) OVER (PARTITION BY feature) AS e FROM {source} WHERE ic IS NOT NULL),
e1 AS (SELECT *, {', '.join(f'lag(e, {k}) OVER (PARTITION BY feature ORDER BY ts) AS lag_{k}' for k in (1, 2, 3))} FROM e0),
nv AS (SELECT feature, count(*) AS n, avg(ic) AS m, sum(e * e) / count(*) + {' + '.join(f'2 * (1 - {k} / 4) * coalesce(sum(e * lag_{k}), 0) / count(*)' for k in (1, 2, 3))} AS v FROM e1 GROUP BY 1),
nw AS (SELECT feature, n, m, CASE WHEN v > 0 THEN m / sqrt(v / n) END AS t FROM nv),
fa AS (SELECT feature, ts, ic, row_number() OVER (PARTITION BY feature ORDER BY ts) - 1 AS k, count(*) OVER (PARTITION BY feature) AS n, avg(ic) OVER (PARTITION BY feature) AS m FROM {source} WHERE ic IS NOT NULL),
ff AS (SELECT *, CAST(CASE WHEN k < (n % 4) * (floor(n / 4) + 1) THEN floor(k / (floor(n / 4) + 1)) ELSE n % 4 + floor((k - (n % 4) * (floor(n / 4) + 1)) / greatest(floor(n / 4), 1)) END AS INTEGER) AS f FROM fa),
fh AS (SELECT *, row_number() OVER (PARTITION BY feature, f ORDER BY ts) AS i FROM ff), fm AS (SELECT feature, f, avg(ic) AS c, any_value(m) AS m FROM fh WHERE f = 0 OR i > 1 GROUP BY 1, 2),
ag AS (SELECT feature, avg(CASE WHEN sign(c) = sign(m) THEN 1.0 ELSE 0.0 END) AS agree FROM fm GROUP BY 1)"""


M13 = f"""WITH {_LONG}, z AS (SELECT ts, symbol, y, day, {_zs('close')} AS level, {_zs('volume')} AS busy, {_zs('spread')} AS spread FROM fe),
l2 AS ({' UNION ALL '.join(f"SELECT '{k}' AS feature, ts, symbol, y, {e} AS x FROM z" for k, e in _GEN)}), {_ic('feature, ts', 'l2')}, {_newey('ic')}
SELECT feature AS strategy, n, round(m, 4) AS mean, round(t, 4) AS t, round(agree, 4) AS agree FROM nw JOIN ag USING (feature)"""


def m14_verdicts(spark, sf):
    """Both sets of rules over the statistics of three features; the last third
    of the dates is the test."""
    f = _features(spark, sf).withColumn("y", C("y") / 1000)
    ic = s.daily_ic(_long(spark, sf), "y", 30)
    p = w.Window.partitionBy("feature")
    late = ic.where("ic is not null").withColumn("_late", F.row_number().over(p.orderBy("ts")) > F.floor(F.count("*").over(p) * 2 / 3))
    test = late.groupBy("feature").agg(F.avg(F.when(C("_late"), C("ic"))).alias("test_ic"), div(F.avg("ic"), F.stddev_samp("ic")).alias("ir"))
    trades = None
    for x in ("level", "busy", "spread"):
        t = s.long_short(f, x, "y", 1, 5, 50, 0.001).select(F.lit(x).alias("feature"), "gross", "net")
        trades = t if trades is None else trades.unionByName(t)
    sharpe = lambda c: div(F.avg(c), F.stddev_samp(c)) * 252 ** 0.5
    d = s.newey_west(ic, "ic", 3, "feature").join(s.fold_signs(ic, 4, 1), "feature").join(test, "feature")
    d = d.join(trades.groupBy("feature").agg(sharpe("gross").alias("gross"), sharpe("net").alias("net")), "feature")
    moments = ic.where("ic is not null").groupBy("feature").agg(F.skewness("ic").alias("sk"), (F.kurtosis("ic") + 3).alias("ku"))
    d = d.join(moments, "feature").withColumn("dsr", stats.probabilistic_sharpe(C("ir"), F.lit(0.0), C("n"), C("sk"), C("ku")))
    return d.select("feature", s.feature_verdict(C("t"), 1.5, C("net"), C("agree"), C("test_ic"), C("mean")).alias("scan"),
                    s.strategy_verdict(C("t"), 1.5, C("ir"), C("gross"), C("net"), C("dsr"), C("agree"), C("test_ic"), C("mean")).alias("verdict"), *rd(net=C("net"), test_ic=C("test_ic")))


def _legs(x: str, k: str) -> str:
    """CTE: gross and net of the long-short portfolio of a column."""
    return f"""leg_{k} AS (SELECT ts, symbol, y / 1000 AS y, row_number() OVER (PARTITION BY ts ORDER BY {x}, symbol) AS r, count(*) OVER (PARTITION BY ts) AS n FROM fe WHERE y IS NOT NULL),
cut_{k} AS (SELECT *, {rank_bucket(5, 'n', 'r')} AS b FROM leg_{k} WHERE n >= 50),
pair_{k} AS (SELECT ts, avg(CASE WHEN b = 5 THEN y END) - avg(CASE WHEN b = 1 THEN y END) AS gross, list(symbol) FILTER (b = 5) AS up, list(symbol) FILTER (b = 1) AS dn FROM cut_{k} GROUP BY 1),
trade_{k} AS (SELECT ts, gross, gross - 0.001 * coalesce(((1 - len(list_intersect(up, lag(up) OVER (ORDER BY ts))) / len(up)) + (1 - len(list_intersect(dn, lag(dn) OVER (ORDER BY ts))) / len(dn))) / 2, 1.0) AS net FROM pair_{k})"""


M14 = f"""WITH {_LONG}, {_ic('feature, ts')}, {_newey('ic')}, {_legs('close', 'a')}, {_legs('volume', 'b')}, {_legs('spread', 'c')},
tr AS (SELECT 'level' AS feature, * FROM trade_a UNION ALL SELECT 'busy', * FROM trade_b UNION ALL SELECT 'spread', * FROM trade_c),
sh AS (SELECT feature, avg(gross) / stddev_samp(gross) * sqrt(252) AS gross, avg(net) / stddev_samp(net) * sqrt(252) AS net FROM tr GROUP BY 1),
te AS (SELECT feature, avg(CASE WHEN k >= floor(n * 2 / 3) THEN ic END) AS test_ic, avg(ic) / stddev_samp(ic) AS ir, avg(pow(ic - m, 3)) / pow(avg(pow(ic - m, 2)), 1.5) AS sk, avg(pow(ic - m, 4)) / pow(avg(pow(ic - m, 2)), 2) AS ku FROM fa GROUP BY 1),
j AS (SELECT *, ir * sqrt(n - 1) / sqrt(1 - sk * ir + (ku - 1) / 4 * ir * ir) AS z FROM nw JOIN ag USING (feature) JOIN sh USING (feature) JOIN te USING (feature)),
q AS (SELECT *, {normal_cdf('z')} AS dsr, (agree >= 0.6 AND sign(test_ic) = sign(m)) AS lasting FROM j)
SELECT feature, CASE WHEN t IS NULL THEN 'insufficient_data' WHEN abs(t) < 1.5 THEN 'noise (fails multiple-testing)' WHEN net <= 0 THEN 'fails net-of-cost' WHEN agree < 0.6 THEN 'unstable across folds'
 WHEN sign(test_ic) <> sign(m) THEN 'decays out-of-sample' ELSE 'CANDIDATE' END AS scan,
 CASE WHEN abs(ir) > 0.5 OR gross > 6 THEN 'AVOID (too good - check leakage)' WHEN coalesce(abs(t), 0) < 1.5 THEN 'NO_EDGE' WHEN dsr >= 0.9 AND net >= 1 AND lasting THEN 'STRONG'
 WHEN dsr >= 0.5 AND net >= 0.4 AND lasting THEN 'PROMISING' ELSE 'MARGINAL' END AS verdict, round(net, 4) AS net, round(test_ic, 4) AS test_ic FROM q"""


def m12_day_states(spark, sf):
    return s.day_states(bars.user_days(spark, sf))


M12D = f"""WITH {USERS}, r AS (SELECT ts, close / nullif(lag(close) OVER {P}, 0) - 1 AS r FROM bars), d AS (SELECT ts, avg(r) AS m, stddev_samp(r) AS s FROM r GROUP BY ts),
e AS (SELECT ts, CASE WHEN count(m) OVER {_before(20)} >= 5 THEN stddev_samp(m) OVER {_before(20)} END AS v, CASE WHEN count(m) OVER {_before(20)} >= 5 THEN avg(m) OVER {_before(20)} END AS t, lag(s) OVER (ORDER BY ts) AS d FROM d),
f AS (SELECT *, avg(v) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS av, avg(d) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ad FROM e)
SELECT ts, CASE WHEN v > av THEN 'HIGH' WHEN v <= av THEN 'LOW' ELSE 'UNKNOWN' END AS vol_state, CASE WHEN t > 0 THEN 'UP' WHEN t <= 0 THEN 'DOWN' ELSE 'UNKNOWN' END AS trend_state,
 CASE WHEN d > ad THEN 'HIGH' WHEN d <= ad THEN 'LOW' ELSE 'UNKNOWN' END AS dispersion_state FROM f"""


def m07_m08_sharpe(spark, sf):
    ic = s.daily_ic(_long(spark, sf), "y", 30).where("ic is not null")
    d = ic.groupBy("feature").agg(F.count("*").alias("n"), (F.avg("ic") / F.stddev_samp("ic")).alias("sr"), F.skewness("ic").alias("sk"), (F.kurtosis("ic") + 3).alias("ku"))
    return d.select("feature", "n", *rd(sr=C("sr"), skew=C("sk"), kurt=C("ku"), psr=stats.probabilistic_sharpe(C("sr"), F.lit(0.0), C("n"), C("sk"), C("ku"))))


M07 = f"""WITH {_LONG}, {_ic('feature, ts')}, a AS (SELECT feature, ic, ic - avg(ic) OVER (PARTITION BY feature) AS e FROM ic WHERE ic IS NOT NULL),
g AS (SELECT feature, count(*) AS n, avg(ic) / stddev_samp(ic) AS sr, avg(e * e * e) / pow(avg(e * e), 1.5) AS sk, avg(e * e * e * e) / pow(avg(e * e), 2) AS ku FROM a GROUP BY 1),
z AS (SELECT *, sr * sqrt(n - 1) / sqrt(1 - sk * sr + (ku - 1) / 4 * sr * sr) AS z FROM g)
SELECT feature, n, round(sr, 4) AS sr, round(sk, 4) AS skew, round(ku, 4) AS kurt, round({normal_cdf('z')}, 4) AS psr FROM z"""


def m20_rank_stability(spark, sf):
    ic = s.daily_ic(_long(spark, sf), "y", 30).where("ic is not null").withColumn("half", F.when(F.dayofmonth("ts") <= 15, "a").otherwise("b"))
    d = ic.groupBy("feature").pivot("half", ["a", "b"]).agg(F.avg("ic"))
    k = lambda c: F.rank().over(w.Window.partitionBy(F.lit("all")).orderBy(C(c).desc()))
    return d.select("feature", (k("b") - k("a")).alias("drift"), *rd(early=C("a"), late=C("b")))


M20 = f"""WITH {_LONG}, {_ic('feature, ts')}, p AS (SELECT feature, avg(ic) FILTER (day(ts) <= 15) AS a, avg(ic) FILTER (day(ts) > 15) AS b FROM ic WHERE ic IS NOT NULL GROUP BY 1)
SELECT feature, CAST(rank() OVER (ORDER BY b DESC) - rank() OVER (ORDER BY a DESC) AS INTEGER) AS drift, round(a, 4) AS early, round(b, 4) AS late FROM p"""


def _summary(d, names):
    """feature, n, mean of every column."""
    return s.long_form(d, names, ["symbol", "ts"]).where("x is not null").groupBy("feature").agg(F.count("*").alias("n"), F.avg("x").alias("m")).select("feature", "n", *rd(mean=C("m")))


def m24_candidates(spark, sf):
    """All 14 transforms of eight columns of a bar, for symbols with 30 bars at
    least; count and mean of each."""
    d = bars.supplier_months(spark, sf)
    rng = C("high") - C("low")
    d = d.withColumns({"range_pct": div(rng, C("close")) * 100, "body": div(C("close") - C("open"), rng), "gap_pct": (div(C("open"), w.delay(C("close"), 1)) - 1) * 100})
    return _summary(*cand.generate(d, _PLAIN))


_PLAIN = ["open", "high", "low", "close", "volume", "range_pct", "body", "gap_pct"]


def m24_factory(spark, sf):
    """All 14 transforms of the 32 base columns and the 17 alphas of the factory
    over daily bars; count and mean of each of the 465."""
    d = cand.factory(bars.supplier_days(spark, sf, "symbol"))
    return d.select("feature", "n", *rd(mean=C("total") / C("n")))


def _cand():
    out = []
    for c in _PLAIN:
        out += [(f"{c}_lag{n}", f"lag({c}, {n}) OVER {P}") for n in (1, 3, 5)] + [(f"{c}_diff{n}", f"{c} - lag({c}, {n}) OVER {P}") for n in (1, 5)]
        for n in (10, 20, 50):
            known = f"list({c}) FILTER ({c} IS NOT NULL) OVER {r(n)}"
            out += [(f"{c}_r{k}{n}", roll(f"{f}({c})", c, n, max(3, n // 4))) for k, f in (("mean", "avg"), ("std", "stddev_samp"))]
            out += [(f"{c}_rrank{n}", f"CASE WHEN {c} IS NOT NULL AND count({c}) OVER {r(n)} >= {max(3, n // 4)} THEN (len(list_filter({known}, lambda q: q < {c})) + (len(list_filter({known}, lambda q: q = {c})) + 1) / 2) / count({c}) OVER {r(n)} END")]
    return out


M24 = f"""WITH {MONTHS}, b AS (SELECT *, (high - low) / nullif(close, 0) * 100 AS range_pct, (close - open) / nullif(high - low, 0) AS body, (open / nullif(lag(close) OVER {P}, 0) - 1) * 100 AS gap_pct, count(*) OVER (PARTITION BY symbol) AS nn FROM bars), g AS (SELECT * FROM b WHERE nn >= 30),
c AS (SELECT {', '.join(f'{e} AS {k}' for k, e in _cand())} FROM g),
u AS ({' UNION ALL '.join(f"SELECT '{k}' AS feature, CAST({k} AS DOUBLE) AS x FROM c" for k, _ in _cand())}) SELECT feature, count(*) AS n, round(avg(x), 4) AS mean FROM u WHERE x IS NOT NULL GROUP BY 1"""


def m25_cross_alphas(spark, sf):
    """Alphas on ranks within the day, then over each symbol's bars."""
    d = bars.supplier_months(spark, sf)
    d = d.withColumns({"ro": w.xs_rank(C("open"), "ts"), "rv": w.xs_rank(C("volume"), "ts")})
    return d.select("symbol", "ts", *rd(x3=-w.corr(C("ro"), C("rv"), 10), x6=-w.corr(C("open"), C("volume"), 10), x33=w.xs_rank(div(C("open"), C("close")), "ts"), x44=-w.corr(C("high"), C("rv"), 5),
                                        x12=F.signum(w.delta(C("volume"))) * -w.delta(C("close")), x101=w.xs_rank((C("close") - C("open")) / (C("high") - C("low") + 1e-9), "ts")))


_cr = lambda a, c, n: f"CASE WHEN isnan({roll(f'corr({a}, {c})', a, n, max(5, n // 2))}) THEN NULL ELSE -({roll(f'corr({a}, {c})', a, n, max(5, n // 2))}) END"
M25 = f"""WITH {MONTHS}, k AS (SELECT *, {xs_rank('open', 'ts')} AS ro, {xs_rank('volume', 'ts')} AS rv, open / nullif(close, 0) AS oc, (close - open) / (high - low + 1e-9) AS body FROM bars)
SELECT symbol, ts, round({_cr('ro', 'rv', 10)}, 4) AS x3, round({_cr('open', 'volume', 10)}, 4) AS x6, round({xs_rank('oc', 'ts')}, 4) AS x33, round({_cr('high', 'rv', 5)}, 4) AS x44, round(sign(volume - lag(volume) OVER {P}) * -(close - lag(close) OVER {P}), 4) AS x12, round({xs_rank('body', 'ts')}, 4) AS x101 FROM k"""


def _trades(spark, sf, n=6):
    d = b.paths(bars.supplier_months(spark, sf), n)
    d = d.withColumns({"tp": F.explode(F.array(F.lit(50.0), F.lit(200.0))), "sl": F.lit(40.0)})
    return b.barrier(d, C("tp"), C("sl"), n)


_TB = f"""p0 AS (SELECT *, {_ld('open', 1)} AS entry, {', '.join(f'{_ld(c, k)} AS {c[0]}{k}' for c in ('high', 'low', 'close') for k in range(1, 7))} FROM bars), p1 AS (SELECT *, tp FROM p0, (VALUES (50.0::DOUBLE), (200.0)) t(tp) WHERE c6 IS NOT NULL AND entry > 0),
p2 AS (SELECT *, CASE {' '.join(f"WHEN l{k} / entry <= 0.6 THEN {k} WHEN h{k} / entry >= 1 + tp / 100 THEN {-k}" for k in range(1, 7))} ELSE 0 END AS hit FROM p1),
p3 AS (SELECT *, CASE WHEN hit = 0 THEN 6 ELSE abs(hit) END AS x, CASE WHEN hit > 0 THEN 'SL' WHEN hit < 0 THEN 'TP' ELSE 'TIME' END AS outcome FROM p2),
tr AS (SELECT *, CASE outcome WHEN 'SL' THEN -40.0 WHEN 'TP' THEN tp ELSE (c6 / entry - 1) * 100 END AS ret, (list_max([h1, h2, h3, h4, h5, h6][1:x]) / entry - 1) * 100 AS mfe, (list_min([l1, l2, l3, l4, l5, l6][1:x]) / entry - 1) * 100 AS mae FROM p3)"""


def b01_b02_barrier(spark, sf):
    return _trades(spark, sf).select("symbol", "ts", "tp", "outcome", "exit_bar", *rd(ret=C("ret"), mfe=C("mfe"), mae=C("mae")))


B01 = f"WITH {MONTHS}, {_TB} SELECT symbol, ts, tp, outcome, CAST(x AS INTEGER) AS exit_bar, round(ret, 4) AS ret, round(mfe, 4) AS mfe, round(mae, 4) AS mae FROM tr"


def a08_b03_summary(spark, sf):
    d = _trades(spark, sf).withColumn("prob", (C("symbol") % 100) / 100).withColumn("bucket", b.bucket(C("prob"), 0.2))
    return b.summary(d, "tp", "bucket").select("tp", "bucket", "n", *rd(**{k: C(k) for k in ("tp_rate", "sl_rate", "time_rate", "win_rate", "expectancy", "mean_mfe", "mean_mae", "hold")}))


_ra = lambda k: f"round(avg(CASE WHEN outcome = '{k}' THEN 1.0 ELSE 0.0 END), 4) AS {k.lower()}_rate"
A08 = f"""WITH {MONTHS}, {_TB} SELECT tp, CAST(floor(round((symbol % 100) / 100 / 0.2, 9)) AS INTEGER) AS bucket, count(*) AS n, {_ra('TP')}, {_ra('SL')}, {_ra('TIME')}, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 4) AS win_rate,
 round(avg(ret), 4) AS expectancy, round(avg(mfe), 4) AS mean_mfe, round(avg(mae), 4) AS mean_mae, round(avg(x), 4) AS hold FROM tr GROUP BY 1, 2"""


def b04_b05_slots(spark, sf):
    m = bars.supplier_months(spark, sf)
    t = _trades(spark, sf).withColumn("score", C("volume"))
    d = b.equity_stats(b.slots(t, m.select("ts"), 5, ["tp"], 2, 0.1), ["tp"], 5, 12.0)
    return d.select("tp", "trades", "days", *rd(**{k: C(k) for k in ("win_rate", "final", "growth", "sharpe", "max_drawdown", "exposure")}))


def b06_top_k(spark, sf):
    d = _features(spark, sf).withColumn("y", C("y") / 1000)
    return b.top_k(d, "level", "y", 10).select("ts", "n", *rd(ret=C("ret"), equity=C("equity")))


B06 = f"""WITH {_LONG}, k AS (SELECT ts, y / 1000 AS y, row_number() OVER (PARTITION BY ts ORDER BY close DESC, symbol) AS k FROM fe WHERE y IS NOT NULL), d AS (SELECT ts, count(*) AS n, avg(y) AS ret FROM k WHERE k <= 10 GROUP BY 1)
SELECT ts, n, round(ret, 4) AS ret, round(exp(sum(ln(1 + ret)) OVER (ORDER BY ts)), 4) AS equity FROM d"""



def a08_scopes(spark, sf):
    """Trade summaries by grouping sets over (target, scope[, bucket | regime])."""
    d = _trades(spark, sf).withColumns({"bucket": b.bucket((C("symbol") % 100) / 100, 0.2), "regime": F.when(F.month("ts") <= 6, "early").otherwise("late")})
    d = b.summary_sets(agg.scopes(d, F.year("ts") >= 2000), ["tp", "scope"], ["bucket", "regime"])
    return d.select("tp", "scope", "level", "bucket", "regime", "n", *rd(**{k: C(k) for k in _SUM}))


_SUM = ["tp_rate", "sl_rate", "time_rate", "win_rate", "expectancy", "mean_mfe", "mean_mae", "hold", "median", "worst_mae", "best_mfe", "time_to_tp", "time_to_sl", "sharpe"]
A08S = f"""WITH {MONTHS}, {_TB}, z AS (SELECT *, CAST(floor(round((symbol % 100) / 100 / 0.2, 9)) AS INTEGER) AS bucket, CASE WHEN month(ts) <= 6 THEN 'early' ELSE 'late' END AS regime FROM tr),
sc AS (SELECT *, 'Full' AS scope FROM z UNION ALL SELECT *, 'OOS' FROM z WHERE year(ts) >= 2000)
SELECT tp, scope, CASE WHEN grouping(bucket) = 0 THEN 'bucket' WHEN grouping(regime) = 0 THEN 'regime' ELSE 'all' END AS level, bucket, regime, count(*) AS n, {_ra('TP')}, {_ra('SL')}, {_ra('TIME')},
 round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 4) AS win_rate, round(avg(ret), 4) AS expectancy, round(avg(mfe), 4) AS mean_mfe, round(avg(mae), 4) AS mean_mae, round(avg(x), 4) AS hold, round(median(ret), 4) AS median,
 round(min(mae), 4) AS worst_mae, round(max(mfe), 4) AS best_mfe, round(avg(x) FILTER (outcome = 'TP'), 4) AS time_to_tp, round(avg(x) FILTER (outcome = 'SL'), 4) AS time_to_sl, round(avg(ret) / (stddev_pop(ret) + 1e-12), 4) AS sharpe
FROM sc GROUP BY GROUPING SETS ((tp, scope), (tp, scope, bucket), (tp, scope, regime))"""


def b06_held(spark, sf):
    d = bars.supplier_months(spark, sf).withColumn("score", F.when(C("volume") > 100, C("volume") - C("close") / 1000))
    return b.held_top_k(d, "score", 5, 10, 0.002).select("ts", "n", "added", *rd(turnover=C("turnover"), pnl=C("pnl"), log_equity=F.log("equity")))


B06H = f"""WITH {MONTHS}, q AS (SELECT *, {_ld('close', 6)} / nullif({_ld('open', 1)}, 0) - 1 AS rr, CASE WHEN volume > 100 THEN volume - close / 1000 END AS score FROM bars),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY score DESC, symbol) AS k FROM q WHERE score IS NOT NULL) WHERE k <= 10), o AS (SELECT *, dense_rank() OVER (ORDER BY ts) AS i FROM k),
h AS (SELECT a.ts, a.rr, CASE WHEN p.symbol IS NULL THEN 1 ELSE 0 END AS fresh FROM o a LEFT JOIN o p ON p.symbol = a.symbol AND p.i = a.i - 1),
g AS (SELECT ts, count(*) AS n, CAST(sum(fresh) AS BIGINT) AS added, avg(rr) AS m FROM h GROUP BY 1), t AS (SELECT *, added / coalesce(lag(n) OVER (ORDER BY ts), 1) AS turnover FROM g),
u AS (SELECT *, coalesce(m, 0) - turnover * 0.002 AS pnl FROM t)
SELECT ts, n, added, round(turnover, 4) AS turnover, round(pnl, 4) AS pnl, round(sum(ln(1 + pnl)) OVER (ORDER BY ts), 4) AS log_equity FROM u"""

QUERIES = {
    "l01_forward": (l01_forward, L01), "l03_bias": (l03_bias, L03), "l04_market_regime": (l04_market_regime, L04), "l05_stock_regime": (l05_stock_regime, L05), "l06_l11_target": (l06_l10_target, L06), "l12_l17_splits": (l12_l17_splits, L12),
    "m01_daily_ic": (m01_daily_ic, M01), "m02_pooled_m04_summary": (m02_pooled_m04_summary, M02), "m03_newey_west": (m03_newey_west, M03), "m10_fold_signs_m15_walk": (m10_fold_signs_m15_walk, M10), "m11_long_short_m09_drawdown": (m11_long_short_m09_drawdown, M11),
    "m21_profile": (m21_profile, M21), "m22_by_group": (m22_by_group_m23_trailing, M22), "m13_strategies": (m13_strategies, M13), "m14_verdicts": (m14_verdicts, M14), "m12_day_states": (m12_day_states, M12D), "m07_m08_sharpe": (m07_m08_sharpe, M07), "m20_rank_stability": (m20_rank_stability, M20),
    "m24_candidates": (m24_candidates, M24), "m24_factory": (m24_factory, None), "m25_cross_alphas": (m25_cross_alphas, M25), "b01_b02_barrier": (b01_b02_barrier, B01), "a08_b03_summary": (a08_b03_summary, A08), "b04_b05_slots": (b04_b05_slots, None), "b06_top_k": (b06_top_k, B06), "a08_scopes": (a08_scopes, A08S), "b06_held": (b06_held, B06H),
}
