"""Queries of joins (J), aggregates (A) and filters (F)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.functions.exprs import corr
from panelforge.operators import aggregates as a
from panelforge.operators import cleaning as c
from panelforge.operators import joins as j
from panelforge.operators import windows as w
from panelforge.plans.sql import BARS, CUM, HOURS, MACRO, MONTHS, P, USERS, rank_bucket, rd, roll
from panelforge.sources import bars

C = F.col


def j01_context(spark, sf):
    d = j.with_context(bars.supplier_days(spark, sf), bars.macro(spark, sf), "ts", ["m_value", "m_orders"])
    return d.select("symbol", "ts", "m_orders", *rd(m_value=C("m_value")))


J01 = f"""WITH {BARS}, {MACRO}, x AS (SELECT symbol, ts, m_value, m_orders FROM bars LEFT JOIN macro USING (ts))
SELECT symbol, ts, last_value(m_orders IGNORE NULLS) OVER {CUM} AS m_orders, round(last_value(m_value IGNORE NULLS) OVER {CUM}, 4) AS m_value FROM x"""


def _daily_context(spark, sf):
    e = bars.event_hours(spark, sf).groupBy("symbol", F.to_date("ts").alias("day")).agg(F.max_by("close", "ts").alias("d_close"), F.sum("volume").alias("d_volume"))
    # Known at the end of the session.
    return e.withColumn("known", (C("day").cast("timestamp_ntz") + F.expr("INTERVAL 23 HOURS")))


def j02_asof(spark, sf):
    return j.asof(bars.event_hours(spark, sf).select("symbol", "ts", "close"), _daily_context(spark, sf), "symbol", "ts", "known", ["d_close", "d_volume"])


J02 = f"""WITH {HOURS}, d AS (SELECT symbol, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 23 HOURS AS known, arg_max(close, ts) AS d_close, sum(volume) AS d_volume FROM bars GROUP BY symbol, CAST(ts AS DATE))
SELECT b.symbol, b.ts, b.close, d_close, d_volume FROM bars b ASOF LEFT JOIN d ON b.symbol = d.symbol AND b.ts > d.known"""


def j03_j06_keyed(spark, sf):
    d = bars.user_days(spark, sf)
    one = d.groupBy("symbol").agg(F.count("*").alias("days"))
    two = d.groupBy("symbol").agg(F.sum("volume").alias("volume_all"))
    three = d.where("volume > 1").groupBy("symbol").agg(F.max("close").alias("busy_high"))
    return j.chain(one, [two, three], "symbol")


J03 = f"""WITH {USERS} SELECT symbol, count(*) AS days, sum(volume) AS volume_all, max(CASE WHEN volume > 1 THEN close END) AS busy_high FROM bars GROUP BY symbol"""


def j07_semi_j08_anti(spark, sf):
    d = bars.user_days(spark, sf)
    top = d.where("close > 100")
    yes, no = j.members(d, top, "symbol"), j.members(d, top, "symbol", False)
    return yes.agg(F.count("*").alias("n"), F.lit("semi").alias("kind")).unionByName(no.agg(F.count("*").alias("n"), F.lit("anti").alias("kind")))


J07 = f"""WITH {USERS}, t AS (SELECT DISTINCT symbol FROM bars WHERE close > 100)
SELECT 'semi' AS kind, count(*) AS n FROM bars WHERE symbol IN (FROM t) UNION ALL SELECT 'anti', count(*) FROM bars WHERE symbol NOT IN (FROM t)"""


def j09_pairs_j10_grid(spark, sf):
    d = bars.event_hours(spark, sf).groupBy("symbol").agg(F.sum("volume").alias("v"))
    ranked = d.withColumn("k", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(C("v").desc(), "symbol")))
    return j.grid(j.pairs(ranked, "symbol", "k"), tp=[2.0, 4.0], sl=[1.0, 2.0])


J09 = f"""WITH {HOURS}, k AS (SELECT symbol, row_number() OVER (ORDER BY sum(volume) DESC, symbol) AS k FROM bars GROUP BY symbol)
SELECT x.symbol AS a, y.symbol AS b, CAST(tp AS DOUBLE) AS tp, CAST(sl AS DOUBLE) AS sl FROM k x JOIN k y ON x.k < y.k, (VALUES (2.0), (4.0)) t(tp), (VALUES (1.0), (2.0)) s(sl)"""


def s15_upsert(spark, sf):
    d = bars.supplier_days(spark, sf)
    new = d.where("ts >= date'2000-01-01'").withColumn("close", C("close") + 1)
    return j.upsert(d.where("ts < date'2000-06-01'"), new, ["symbol", "ts"]).select("symbol", "ts", "close", "volume")


S15 = f"WITH {BARS} SELECT symbol, ts, CASE WHEN ts >= DATE '2000-01-01' THEN close + 1 ELSE close END AS close, volume FROM bars"


def a01_market_a22_distinct(spark, sf):
    d = bars.supplier_days(spark, sf).withColumn("ret", w.pct_change(C("close")))
    return d.groupBy("ts").agg(F.countDistinct("symbol").alias("names"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s")).select("ts", "names", *rd(mean=C("m"), spread=C("s")))


A01 = f"""WITH {BARS}, x AS (SELECT *, close / nullif(lag(close) OVER {P}, 0) - 1 AS ret FROM bars) SELECT ts, count(DISTINCT symbol) AS names, round(avg(ret), 4) AS mean, round(stddev_samp(ret), 4) AS spread FROM x GROUP BY ts"""


def a02_weeks_a17_last(spark, sf):
    from panelforge.operators.daily import week_end
    d = bars.supplier_days(spark, sf)
    wk = d.groupBy("symbol", week_end(C("ts")).alias("wk")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
    last = wk.groupBy("symbol").agg(F.max("wk").alias("wk")).withColumn("is_last", F.lit(True))
    return wk.join(last, ["symbol", "wk"], "left").withColumn("is_last", F.coalesce("is_last", F.lit(False)))


A02 = f"""WITH {BARS}, x AS (SELECT *, ts + CAST((12 - isodow(ts)) % 7 AS INTEGER) AS wk FROM bars), k AS (SELECT symbol, wk, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM x GROUP BY 1, 2)
SELECT *, wk = max(wk) OVER (PARTITION BY symbol) AS is_last FROM k"""


def a04_deciles_a05_value_cut(spark, sf):
    d = bars.supplier_months(spark, sf).withColumn("ret", (w.lead(C("close"), 1) / C("close") - 1) * 100).where("ret is not null")
    g = a.with_value_bucket(d, "volume", 10, "bucket").groupBy("bucket").agg(F.count("*").alias("n"), F.avg("volume").alias("v"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"), F.percentile("ret", 0.5).alias("md"))
    return g.select("bucket", "n", *rd(mean_volume=C("v"), mean_ret=C("m"), spread=C("s"), median=C("md")))


A04 = f"""WITH {MONTHS}, x AS (SELECT *, (lead(close) OVER {P} / nullif(close, 0) - 1) * 100 AS ret FROM bars), y AS (SELECT * FROM x WHERE ret IS NOT NULL),
e AS (SELECT list_sort(list_distinct(quantile_cont(volume, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS e FROM y),
z AS (SELECT *, CAST(greatest(len(list_filter(e, lambda q: q < volume)), 1) AS INTEGER) AS bucket FROM y, e)
SELECT bucket, count(*) AS n, round(avg(volume), 4) AS mean_volume, round(avg(ret), 4) AS mean_ret, round(stddev_samp(ret), 4) AS spread, round(median(ret), 4) AS median FROM z GROUP BY bucket"""


def a06_rank_cut(spark, sf):
    d = bars.user_days(spark, sf)
    return d.select("symbol", "ts", a.rank_bucket(C("close"), 5, "ts", ties=("symbol",)).alias("bucket"))


A06 = f"""WITH {USERS}, x AS (SELECT symbol, ts, row_number() OVER (PARTITION BY ts ORDER BY close, symbol) AS k, count(*) OVER (PARTITION BY ts) AS n FROM bars)
SELECT symbol, ts, {rank_bucket(5, 'n', 'k')} AS bucket FROM x"""


def _scored(spark, sf):
    d = bars.user_days(spark, sf)
    d = d.withColumns({"prob": w.xs_rank(C("close"), "ts"), "ret": w.lead(C("close"), 1) - C("close")})
    return d.where("ret is not null").withColumn("oos", C("ts") >= F.lit("2024-01-20").cast("date"))


_SC = f"""{USERS}, s0 AS (SELECT *, (rank() OVER (PARTITION BY ts ORDER BY close) + (count(close) OVER (PARTITION BY ts, close) - 1) / 2) / count(close) OVER (PARTITION BY ts) AS prob,
 lead(close) OVER {P} - close AS ret, ts >= DATE '2024-01-20' AS oos FROM bars), s AS (SELECT * FROM s0 WHERE ret IS NOT NULL)"""


def a07_a09_report(spark, sf):
    d = a.scopes(_scored(spark, sf), C("oos")).withColumn("bucket", F.floor(F.round(C("prob") / 0.05, 9)).cast("int"))
    return a.report(d, "ret", "scope", "bucket").select("scope", "bucket", "n", *rd(**{k: C(k) for k in ("win_rate", "mean", "mean_win", "mean_loss", "median", "spread", "sharpe")}))


A07 = f"""WITH {_SC}, t AS (SELECT 'Full' AS scope, * FROM s UNION ALL SELECT 'OOS', * FROM s WHERE oos), u AS (SELECT *, CAST(floor(round(prob / 0.05, 9)) AS INTEGER) AS bucket FROM t)
SELECT scope, bucket, count(ret) AS n, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 4) AS win_rate, round(avg(ret), 4) AS mean, round(avg(CASE WHEN ret > 0 THEN ret END), 4) AS mean_win, round(avg(CASE WHEN ret <= 0 THEN ret END), 4) AS mean_loss,
 round(median(ret), 4) AS median, round(stddev_pop(ret), 4) AS spread, round(avg(ret) / nullif(stddev_pop(ret), 0), 4) AS sharpe FROM u GROUP BY scope, bucket"""


def a10_thresholds_a11_frequency(spark, sf):
    d = a.at_least(_scored(spark, sf), "prob", [0.5, 0.7, 0.9, 0.95])
    return d.groupBy("threshold").agg(F.count("*").alias("n"), F.countDistinct("ts").alias("days"), F.avg("ret").alias("m")).select(
        "threshold", "n", "days", *rd(per_day=C("n") / C("days"), mean=C("m")))


A10 = f"""WITH {_SC} SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) AS n, count(DISTINCT ts) AS days, round(count(*) / count(DISTINCT ts), 4) AS per_day, round(avg(ret), 4) AS mean
FROM s JOIN (VALUES (0.5), (0.7), (0.9), (0.95)) t(threshold) ON prob >= CAST(threshold AS DOUBLE) GROUP BY 1"""


def a12_costs(spark, sf):
    d = j.grid(_scored(spark, sf).where("prob >= 0.7"), bps=[0.0, 10.0, 25.0, 50.0]).withColumn("net", C("ret") - C("bps") / 100)
    return d.groupBy("bps").agg(F.count("*").alias("n"), F.avg("net").alias("m"), F.stddev_samp("net").alias("s")).select("bps", "n", *rd(mean=C("m"), spread=C("s"), sharpe=C("m") / C("s")))


A12 = f"""WITH {_SC} SELECT CAST(b AS DOUBLE) AS bps, count(*) AS n, round(avg(ret - b / 100), 4) AS mean, round(stddev_samp(ret - b / 100), 4) AS spread, round(avg(ret - b / 100) / stddev_samp(ret - b / 100), 4) AS sharpe
FROM s, (VALUES (0::DOUBLE), (10), (25), (50)) t(b) WHERE prob >= 0.7 GROUP BY b"""


def a13_families_a15_counts(spark, sf):
    e = bars.table(spark, sf, "orders")
    tags = F.filter(F.array(F.when(C("o_totalprice") > 100000, "large"), F.when(C("o_orderstatus") == "O", "open"), F.when(C("o_orderpriority").rlike("^[12]"), "urgent")), lambda t: t.isNotNull())
    return e.withColumn("tag", F.explode(tags)).groupBy("tag").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("m")).select("tag", "n", *rd(mean=C("m")))


A13 = """SELECT tag, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM (SELECT *, unnest([CASE WHEN o_totalprice > 100000 THEN 'large' END, CASE WHEN o_orderstatus = 'O' THEN 'open' END, CASE WHEN regexp_matches(o_orderpriority, '^[12]') THEN 'urgent' END]) AS tag FROM orders) WHERE tag IS NOT NULL GROUP BY tag"""


def a14_consistency_a18_years(spark, sf):
    d = bars.supplier_days(spark, sf).withColumn("ret", w.pct_change(C("close"))).groupBy("symbol", F.year("ts").alias("year")).agg(F.avg("ret").alias("m"))
    all_ = F.avg("m").over(Window.partitionBy("symbol"))
    d = d.withColumn("hit", (F.signum("m") == F.signum(all_)).cast("double"))
    return d.groupBy("symbol").agg(F.min("m").alias("lo"), F.max("m").alias("hi"), F.stddev_samp("m").alias("s"), F.max_by("year", "m").alias("best"), F.avg("hit").alias("h")).select("symbol", "best", *rd(lowest=C("lo"), highest=C("hi"), spread=C("s"), year_hit=C("h")))


A14 = f"""WITH {BARS}, x AS (SELECT *, close / nullif(lag(close) OVER {P}, 0) - 1 AS ret FROM bars), y AS (SELECT symbol, year(ts) AS yr, avg(ret) AS m FROM x GROUP BY 1, 2), z AS (SELECT *, avg(m) OVER (PARTITION BY symbol) AS am FROM y)
SELECT symbol, CAST(arg_max(yr, m) AS INTEGER) AS best, round(min(m), 4) AS lowest, round(max(m), 4) AS highest, round(stddev_samp(m), 4) AS spread, round(avg(CASE WHEN m IS NOT NULL THEN CASE WHEN sign(m) = sign(am) THEN 1.0 ELSE 0.0 END END), 4) AS year_hit FROM z GROUP BY symbol"""


def a16_survivors_a19_breadth(spark, sf):
    d = bars.user_days(spark, sf)
    return a.survivors(d, 3).crossJoin(a.breadth(d, 100)).select("symbols", "dates", "median_names", "thin", *rd(alive=C("alive")))


A16 = f"""WITH {USERS}, l AS (SELECT symbol, max(ts) AS last FROM bars GROUP BY 1), n AS (SELECT ts, count(DISTINCT symbol) AS n FROM bars GROUP BY 1)
SELECT (SELECT count(*) FROM l) AS symbols, (SELECT round(avg(CASE WHEN (SELECT max(last) FROM l) - last <= 3 THEN 1.0 ELSE 0.0 END), 4) FROM l) AS alive, count(*) AS dates, median(n) AS median_names, count(*) FILTER (n < 100) AS thin FROM n"""


def a20_rank_matrix_a21_pivot(spark, sf):
    cols = ["open", "close", "volume"]
    d = bars.supplier_months(spark, sf)
    d = d.select(*[(F.rank().over(Window.partitionBy(F.lit(1)).orderBy(k)) + (F.count("*").over(Window.partitionBy(k)) - 1) / 2).alias(k) for k in cols])
    long = d.agg(*[corr(C(x), C(y)).alias(f"{x}|{y}") for x in cols for y in cols])
    long = long.unpivot([], [f"{x}|{y}" for x in cols for y in cols], "pair", "c")
    s = F.split("pair", r"\|")
    return long.groupBy(s[0].alias("feature")).pivot("pair", [f"{x}|{y}" for x in cols for y in cols]).agg(F.first("c")).select(
        "feature", *rd(**{f"with_{y}": F.coalesce(*[C(f"`{x}|{y}`") for x in cols]) for y in cols}))


_rk = lambda k: f"rank() OVER (ORDER BY {k}) + (count(*) OVER (PARTITION BY {k}) - 1) / 2 AS {k}"
A20 = f"""WITH {MONTHS}, x AS (SELECT {_rk('open')}, {_rk('close')}, {_rk('volume')} FROM bars)
SELECT 'open' AS feature, round(corr(open, open), 4) AS with_open, round(corr(open, close), 4) AS with_close, round(corr(open, volume), 4) AS with_volume FROM x UNION ALL
SELECT 'close', round(corr(close, open), 4), round(corr(close, close), 4), round(corr(close, volume), 4) FROM x UNION ALL SELECT 'volume', round(corr(volume, open), 4), round(corr(volume, close), 4), round(corr(volume, volume), 4) FROM x"""


def a23_volume_mode(spark, sf):
    d = bars.supplier_days(spark, sf).withColumn("p", (C("high") + C("low") + C("close")) / 3)
    r = d.groupBy("symbol").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    b = F.least(F.floor((C("p") - C("lo")) / (C("hi") - C("lo")) * 50), F.lit(49))
    h = d.join(r, "symbol").groupBy("symbol", "lo", "hi", b.alias("bin")).agg(F.sum("volume").alias("v"))
    top = h.groupBy("symbol", "lo", "hi").agg(F.max_by("bin", F.struct("v", -C("bin"))).alias("bin"))
    return top.select("symbol", *rd(node=C("lo") + (C("hi") - C("lo")) * (2 * C("bin") + 1) / 100))


A23 = f"""WITH {BARS}, x AS (SELECT symbol, (high + low + close) / 3 AS p, volume, min(p) OVER (PARTITION BY symbol) AS lo, max(p) OVER (PARTITION BY symbol) AS hi FROM bars),
h AS (SELECT symbol, lo, hi, least(floor((p - lo) / (hi - lo) * 50), 49) AS bin, sum(volume) AS v FROM x GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY v DESC, bin) AS k FROM h)
SELECT symbol, round(lo + (hi - lo) * (2 * bin + 1) / 100, 4) AS node FROM m WHERE k = 1"""


def f05_f06_universe(spark, sf):
    d = bars.supplier_days(spark, sf)
    return c.liquid(d.withColumn("tradeable", c.tradeable(500.0, 20000.0)), 2.0, 20.0).select("symbol", "ts", "tradeable")


F05 = f"""WITH {BARS}, x AS (SELECT *, avg(volume) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m, {roll('avg(close * volume)', 'close', 20, 10)} AS t FROM bars)
SELECT symbol, ts, coalesce(t >= 20000.0 AND close >= 500.0, false) AS tradeable FROM x WHERE close >= 2.0 AND m >= 20.0"""


def f04_f08_checks(spark, sf):
    d = bars.supplier_days(spark, sf)
    rsi = C("close").between(0, 100)
    # The bars of some days twice, so that there are times that don't rise.
    bad = d.unionByName(d.where((C("symbol") % 3 == 0) & (F.dayofmonth("ts") <= 10)))
    return c.monotonic_errors(bad).agg(F.count("*").alias("not_rising")).crossJoin(c.fresh(d, 7).agg(F.count("*").alias("fresh_rows"), F.countDistinct("symbol").alias("fresh_symbols"), F.count_if(~rsi).alias("out_of_range")))


F04 = f"""WITH {BARS}, l AS (SELECT symbol, max(ts) AS last FROM bars GROUP BY 1), k AS (SELECT * FROM bars WHERE symbol IN (SELECT symbol FROM l WHERE (SELECT max(last) FROM l) - last <= 7))
SELECT (SELECT count(*) FROM (SELECT ts <= lag(ts) OVER {P} AS bad FROM (SELECT symbol, ts FROM bars UNION ALL SELECT symbol, ts FROM bars WHERE symbol % 3 = 0 AND day(ts) <= 10)) WHERE bad) AS not_rising, count(*) AS fresh_rows, count(DISTINCT symbol) AS fresh_symbols, count(*) FILTER (NOT (close BETWEEN 0 AND 100)) AS out_of_range FROM k"""


def f14_f16_impute_fill(spark, sf):
    d = bars.supplier_days(spark, sf).withColumn("x", F.when(C("volume") > 10, C("volume"))).withColumn("y", C("x"))
    d = c.fill_forward(c.impute(d, ["x"], C("ts") < F.lit("1998-01-01").cast("date")), ["y"])
    return d.select("symbol", "ts", "x", "y", *[v.alias(k) for k, v in c.one_hot(F.month("ts"), [1, 6, 12], "month").items()])


F14 = f"""WITH {BARS}, a AS (SELECT *, CASE WHEN volume > 10 THEN volume END AS v FROM bars) SELECT symbol, ts, coalesce(v, (SELECT median(v) FROM a WHERE ts < DATE '1998-01-01')) AS x, coalesce(last_value(v IGNORE NULLS) OVER {CUM}, 0.0) AS y,
 CAST(month(ts) = 1 AS INTEGER) AS month_1, CAST(month(ts) = 6 AS INTEGER) AS month_6, CAST(month(ts) = 12 AS INTEGER) AS month_12 FROM a"""


def f01_f20_text(spark, sf):
    d = bars.table(spark, sf, "customer")
    s = F.when(C("c_custkey") % 10 == 0, F.lit(" Ticker ")).when(C("c_custkey") % 10 == 1, F.lit(" <?> ")).otherwise(F.concat(F.lit("\ufeff nse: "), C("c_name"), F.lit("/\t -eq")))
    when = F.date_add(F.lit("2020-01-01").cast("date"), (C("c_custkey") % 900).cast("int"))
    formats = ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "MM/dd/yyyy", "dd.MM.yyyy", "yyyyMMdd")
    day = F.lit(None).cast("string")
    for k, f in enumerate(formats):
        day = F.when(C("c_custkey") % 6 == k, F.date_format(when, f)).otherwise(day)
    span = c.date_range(day, F.lit("2020-10-15"), F.lit("2021-06-30").cast("date"))
    return d.select("c_custkey", c.clean_symbol(s).alias("symbol"), c.parse_date(day).alias("day"), *[v.alias(k) for k, v in span.items()], c.num(C("c_name")).alias("bad"), c.num(C("c_custkey").cast("string")).alias("good"),
                    c.bool_text(F.when(C("c_custkey") % 2 == 0, "TRUE").otherwise(" false")).alias("flag"))


F01 = """WITH w AS (SELECT *, CAST(DATE '2020-01-01' + CAST(c_custkey % 900 AS INTEGER) AS DATE) AS dy FROM customer),
d AS (SELECT *, CASE WHEN c_custkey % 6 = 5 THEN NULL WHEN c_custkey % 6 = 3 AND day(dy) <= 12 THEN make_date(year(dy), day(dy), month(dy)) ELSE dy END AS d FROM w)
SELECT c_custkey, CASE WHEN c_custkey % 10 < 2 THEN NULL ELSE 'nse ' || c_name || ' -eq' END AS symbol, d AS day, least(d, DATE '2020-10-15') + CASE WHEN d IS NOT NULL THEN 0 END AS first,
 least(greatest(d, DATE '2020-10-15'), DATE '2021-06-30') + CASE WHEN d IS NOT NULL THEN 0 END AS last, CAST(NULL AS DOUBLE) AS bad, CAST(c_custkey AS DOUBLE) AS good,
 CASE WHEN c_custkey % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS flag FROM d"""

QUERIES = {
    "j01_context": (j01_context, J01), "j02_asof": (j02_asof, J02), "j03_j06_keyed": (j03_j06_keyed, J03), "j07_semi_j08_anti": (j07_semi_j08_anti, J07), "j09_pairs_j10_grid": (j09_pairs_j10_grid, J09),
    "s15_upsert": (s15_upsert, S15), "a01_market_a22_distinct": (a01_market_a22_distinct, A01), "a02_weeks_a17_last": (a02_weeks_a17_last, A02), "a04_deciles_a05_value_cut": (a04_deciles_a05_value_cut, A04),
    "a06_rank_cut": (a06_rank_cut, A06), "a07_a09_report": (a07_a09_report, A07), "a10_thresholds_a11_frequency": (a10_thresholds_a11_frequency, A10), "a12_costs": (a12_costs, A12), "a13_families_a15_counts": (a13_families_a15_counts, A13),
    "a14_consistency_a18_years": (a14_consistency_a18_years, A14), "a16_survivors_a19_breadth": (a16_survivors_a19_breadth, A16), "a20_rank_matrix_a21_pivot": (a20_rank_matrix_a21_pivot, A20), "a23_volume_mode": (a23_volume_mode, A23),
    "f05_f06_universe": (f05_f06_universe, F05), "f04_f08_checks": (f04_f08_checks, F04), "f14_f16_impute_fill": (f14_f16_impute_fill, F14), "f01_f20_text": (f01_f20_text, F01),
}
