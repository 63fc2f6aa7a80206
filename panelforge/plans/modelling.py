"""Queries of models (G) and sources (S), and the streamed bars."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.operators import labels as la
from panelforge.operators import model as g
from panelforge.operators import scoring as s
from panelforge.operators import windows as w
from panelforge.plans.sql import BARS, HOURS, MACRO, P, USERS, rd
from panelforge.sources import bars, files
from panelforge.streaming.bars import stream_bars

C = F.col
FEATURES = ["level", "busy", "spread", "past"]


def panel(spark, sf):
    """Users' days with four features, the next change and its class."""
    d = bars.user_days(spark, sf)
    d = d.withColumns({"level": C("close"), "busy": C("volume"), "spread": C("high") - C("low"), "past": w.delta(C("close")), "y": w.lead(C("close"), 1) - C("close")})
    d = d.withColumn("rank", w.xs_rank(C("y"), "ts")).withColumn("label", F.when(C("rank") >= 0.7, 1).when(C("rank") <= 0.3, 0))
    d = d.withColumn("regime", F.when(F.dayofmonth("ts") % 2 == 0, "even").otherwise("odd"))
    return d.join(F.broadcast(la.three_way(d, embargo=1)), "ts").where("past is not null")


def g01_g05_members(spark, sf):
    """Two seeds' members fitted on the training days score the test days; the
    pooled score and one regime's own, routed, with their quality."""
    d = panel(spark, sf).persist()
    train, test = d.where("part = 'train'"), d.where("part = 'test'")
    fits = [(train, 1), (train, 2), (train.where("regime = 'even'"), 3)]
    *two, one = g.at_once(lambda x: g.member(x[0], FEATURES, "label", x[1]), fits)
    pooled, even = (g.score([m for m in ms if m is not None], test, FEATURES) for ms in (two, [one]))
    return g.routed(pooled, {"even": even}, ["symbol", "ts"]).select("symbol", "ts", "regime", *rd(prob=C("prob_mean"), spread=C("prob_std"), routed=C("routed")))


def g02_g12_calibration(spark, sf):
    """A calibrated probability and the expected change it maps to."""
    d = panel(spark, sf).persist()
    s = g.score([g.member(d.where("part = 'train'"), FEATURES, "label", 1)], d.where("part = 'cal'"), FEATURES)
    kind, cal = g.calibrate(s, "prob_mean", "label")
    ev = g.expected_value(s, "prob_mean", "y")
    return ev.transform(s).select("symbol", "ts", F.lit(kind).alias("kind"), *rd(prob=C("prob_mean"), expected=C("prediction")))


def g06_interpolate(spark, sf):
    d = panel(spark, sf)
    return d.select("symbol", "ts", *rd(expected=g.interpolate(C("level"), [(10.0, -1.0), (50.0, 0.5), (200.0, 3.0)])))


G06 = f"""WITH {USERS}, x AS (SELECT *, lag(close) OVER {P} AS pc FROM bars) SELECT symbol, ts, round(CASE WHEN close <= 10 THEN -1.0 WHEN close <= 50 THEN -1.0 + (close - 10) * (1.5 / 40) WHEN close <= 200 THEN 0.5 + (close - 50) * (2.5 / 150) ELSE 3.0 END, 4) AS expected FROM x WHERE pc IS NOT NULL"""


def g07_quality(spark, sf):
    d = panel(spark, sf).withColumn("prob", w.xs_rank(C("level"), "ts"))
    return g.quality(d, "prob", "label", "y", "regime").select("regime", "n", *rd(brier=C("brier"), ic=C("ic")))


_rk = lambda c, k: f"rank() OVER (PARTITION BY {k} ORDER BY {c}) + (count(*) OVER (PARTITION BY {k}, {c}) - 1) / 2"
G07 = f"""WITH {USERS}, a AS (SELECT *, lag(close) OVER {P} AS pc, lead(close) OVER {P} - close AS y FROM bars), b AS (SELECT *, CASE WHEN y IS NOT NULL THEN (rank() OVER (PARTITION BY ts ORDER BY y NULLS LAST) + (count(y) OVER (PARTITION BY ts, y) - 1) / 2) / count(y) OVER (PARTITION BY ts) END AS rk FROM a),
c AS (SELECT *, ({_rk('close', 'ts')}) / count(*) OVER (PARTITION BY ts) AS prob, CASE WHEN rk >= 0.7 THEN 1 WHEN rk <= 0.3 THEN 0 END AS label, CASE WHEN day(ts) % 2 = 0 THEN 'even' ELSE 'odd' END AS regime FROM b WHERE pc IS NOT NULL),
d AS (SELECT * FROM c WHERE label IS NOT NULL), e AS (SELECT *, {_rk('prob', 'regime')} AS ra, {_rk('y', 'regime')} AS rb FROM d)
SELECT regime, count(*) AS n, round(avg((prob - label) * (prob - label)), 4) AS brier, round(corr(ra, rb), 4) AS ic FROM e GROUP BY regime"""


def g08_g10_importance(spark, sf):
    """Fall of the area under the curve by shuffled feature on the test days,
    over all and within regimes, rank correlations within regimes, the advice of
    all these, and mean and spread of the fall over purged folds."""
    d = panel(spark, sf).persist()
    train, test = d.where("part = 'train'"), d.where("part = 'test'")
    m = g.member(train, FEATURES, "label", 1)
    cv = {f: x for f, *x in g.cv_permutation_importance(train, FEATURES, "label", embargo=1)}
    fall = dict(g.permutation_importance(m, test, FEATURES, "label"))
    regimes = {r: t for r in ("even", "odd") if g.has_two_classes(t := test.where(C("regime") == r), "label")}
    within = {r: dict(g.permutation_importance(m, t, FEATURES, "label")) for r, t in regimes.items()}
    known = lambda x: None if x is None else float(x)
    rows = [(f, known(fall.get(f)), [known(within[r].get(f)) for r in within], *cv.get(f, (None, None, 0))) for f in FEATURES]
    falls = spark.createDataFrame(rows, "feature string, fall double, by_regime array<double>, cv_fall double, cv_spread double, cv_folds int")
    long = s.long_form(d.withColumns({f: C(f).cast("double") for f in FEATURES}), FEATURES, ["symbol", "ts", "y", "regime"])
    ic = s.by_group(long, "y", "regime", 20).groupBy("feature").agg(
        F.collect_list(F.when(C("group") != "ALL", C("mean"))).alias("ics"), F.abs(F.max(F.when(C("group") == "ALL", C("mean")))).alias("mean_abs_ic"))
    out = falls.join(ic, "feature", "left").withColumn("ics", F.coalesce("ics", F.array().cast("array<double>")))
    return out.select("feature", "fall", g.recommend(C("fall"), C("by_regime"), C("ics"), C("mean_abs_ic")).alias("advice"), "cv_fall", "cv_spread", "cv_folds")


def g09_selection(spark, sf):
    """Features in the order in which they raise the area over purged folds of
    the training days; any number of them."""
    d = panel(spark, sf).where("part = 'train'").persist()
    got = g.forward_selection(d, FEATURES, "label", len(FEATURES), embargo=1)
    d.unpersist()
    return spark.createDataFrame([(k, f) for k, f in enumerate(got)], "place int, feature string")


def g11_watchlist(spark, sf):
    d = panel(spark, sf).withColumns({"prob_mean": w.xs_rank(C("level"), "ts"), "prob_std": F.lit(0.01)})
    return g.watchlist(d, [(0.0, -1.0), (1.0, 1.0)], 0.05, 25).select("symbol", "ts", *rd(prob=C("prob_mean"), expected=C("expected")))


G11 = f"""WITH {USERS}, a AS (SELECT *, lag(close) OVER {P} AS pc FROM bars), b AS (SELECT *, ({_rk('close', 'ts')}) / count(*) OVER (PARTITION BY ts) AS prob FROM a WHERE pc IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM b),
o AS (SELECT * FROM k WHERE k = 1 ORDER BY prob DESC, symbol LIMIT 25) SELECT symbol, ts, round(prob, 4) AS prob, round(-1.0 + prob * 2, 4) AS expected FROM o"""


def s01_projection(spark, sf):
    d = files.read_columns(spark, f"{sf}/lineitem.parquet", ["l_suppkey", "l_shipdate", "l_quantity"])
    return d.where("l_quantity >= 49").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.max(F.to_date("l_shipdate")).alias("last"))


S01 = "SELECT l_suppkey, count(*) AS n, CAST(max(l_shipdate) AS DATE) AS last FROM lineitem WHERE l_quantity >= 49 GROUP BY 1"


def s14_panel(spark, sf):
    """The line items as a panel by day with the orders' daily macro row."""
    m = bars.macro(spark, sf).withColumnRenamed("ts", "date")
    d = files.load_panel(spark, f"{sf}/lineitem.parquet", ts="l_shipdate", symbol="l_suppkey", macro=m)
    return d.groupBy("symbol", "date").agg(F.count("*").alias("n"), F.max("m_orders").alias("m_orders"), F.max("m_value").alias("v")).select("symbol", "date", "n", "m_orders", *rd(m_value=C("v")))


S14 = f"""WITH {MACRO} SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, count(*) AS n, max(m_orders) AS m_orders, round(max(m_value), 4) AS m_value FROM lineitem LEFT JOIN macro ON macro.ts = CAST(l_shipdate AS DATE) WHERE l_shipdate IS NOT NULL GROUP BY 1, 2"""


def s04_manifest(spark, sf):
    d = bars.supplier_days(spark, sf).withColumn("gap", w.delta(C("close"), 5))
    return files.manifest(d.select("ts", "close", "gap"), "ts").select("rows", "first", "last", *rd(null_close=C("null_close"), null_gap=C("null_gap")))


S04 = f"""WITH {BARS}, x AS (SELECT *, lag(close, 5) OVER {P} AS l FROM bars) SELECT count(*) AS rows, min(ts) AS first, max(ts) AS last, round(avg(CASE WHEN close IS NULL THEN 1.0 ELSE 0.0 END), 4) AS null_close, round(avg(CASE WHEN l IS NULL THEN 1.0 ELSE 0.0 END), 4) AS null_gap FROM x"""


def s12_fetch_plan(spark, sf):
    d = bars.supplier_days(spark, sf).groupBy("symbol").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    return files.fetch_plan(d, 500)


S12 = f"""WITH {BARS}, r AS (SELECT symbol, min(ts) AS a, max(ts) AS b FROM bars GROUP BY 1), u AS (SELECT symbol, b, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 500 DAYS)) AS DATE) AS f FROM r)
SELECT symbol, f AS first, least(f + 499, b) AS last FROM u"""


def s13_resolve(spark, sf):
    s = bars.table(spark, sf, "supplier").select(F.regexp_replace("s_name", "#0*", "-").alias("symbol"))
    i = bars.table(spark, sf, "supplier").select(F.when(C("s_suppkey") % 3 == 0, F.concat(F.upper(F.regexp_replace("s_name", "#0*", "-")), F.lit("-EQ"))).otherwise(F.upper(F.regexp_replace("s_name", "#0*", "_"))).alias("name"), C("s_suppkey").alias("token"))
    return files.resolve(s, i)


S13 = r"""WITH s AS (SELECT regexp_replace(s_name, '#0*', '-') AS symbol FROM supplier), i AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN upper(regexp_replace(s_name, '#0*', '-')) || '-EQ' ELSE upper(regexp_replace(s_name, '#0*', '_')) END AS name, s_suppkey AS token FROM supplier),
o AS (SELECT name, min(token) AS t FROM i GROUP BY 1), l AS (SELECT regexp_replace(name, '(-EQ|-BE)$|[^A-Z0-9]', '', 'g') AS n, min(token) AS t FROM i GROUP BY 1)
SELECT symbol, coalesce(o.t, q.t, l.t) AS token, CASE WHEN o.t IS NOT NULL THEN 'exact' WHEN q.t IS NOT NULL THEN 'suffix' WHEN l.t IS NOT NULL THEN 'base' END AS how
FROM s LEFT JOIN o ON o.name = upper(symbol) LEFT JOIN o q ON q.name = upper(symbol) || '-EQ' LEFT JOIN l ON l.n = regexp_replace(upper(symbol), '(-EQ|-BE)$|[^A-Z0-9]', '', 'g')"""


def s18_rejects(spark, sf):
    d = bars.table(spark, sf, "orders").select("o_orderkey", F.when(C("o_orderkey") % 7 == 0, "n/a").otherwise(C("o_totalprice").cast("string")).alias("price"), F.when(C("o_orderkey") % 11 == 0, "x").otherwise("1").alias("size"))
    return files.rejects(d, ["price", "size"]).select("o_orderkey", F.array_join("bad", ",").alias("bad"))


S18 = "SELECT o_orderkey, CASE WHEN o_orderkey % 77 = 0 THEN 'price,size' WHEN o_orderkey % 7 = 0 THEN 'price' ELSE 'size' END AS bad FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0"


def stream_hours(spark, sf):
    """The streamed bars' transformation on the table as it stands."""
    d = stream_bars(bars.table(spark, sf, "events"), "1 hour")
    return d.withColumn("ts", C("ts").cast("timestamp_ntz"))


SH = f"WITH {HOURS} SELECT symbol, ts, open, high, low, close, volume FROM bars"


def top_volume_s09(spark, sf):
    """Report: the ten most traded symbols."""
    d = bars.supplier_days(spark, sf).groupBy("symbol").agg(F.sum("volume").alias("volume"), F.count("*").alias("days"))
    return d.withColumn("place", F.row_number().over(Window.partitionBy(F.lit("all")).orderBy(C("volume").desc(), "symbol"))).where("place <= 10")


TV = f"WITH {BARS}, g AS (SELECT symbol, sum(volume) AS volume, count(*) AS days FROM bars GROUP BY 1), k AS (SELECT *, CAST(row_number() OVER (ORDER BY volume DESC, symbol) AS INTEGER) AS place FROM g) SELECT * FROM k WHERE place <= 10"

QUERIES = {
    "g01_g05_members": (g01_g05_members, None), "g02_g12_calibration": (g02_g12_calibration, None), "g06_interpolate": (g06_interpolate, G06), "g07_quality": (g07_quality, G07), "g08_g10_importance": (g08_g10_importance, None),
    "g09_selection": (g09_selection, None), "g11_watchlist": (g11_watchlist, G11), "s01_projection": (s01_projection, S01), "s14_panel": (s14_panel, S14), "s04_manifest": (s04_manifest, S04), "s12_fetch_plan": (s12_fetch_plan, S12), "s13_resolve": (s13_resolve, S13),
    "s18_rejects": (s18_rejects, S18), "stream_hours": (stream_hours, SH), "s09_report": (top_volume_s09, TV),
}
