"""Operators on small frames, against pandas or by hand."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions import stats
from panelforge.functions.exprs import clip, div, flag, num
from panelforge.operators import aggregates as agg
from panelforge.operators import backtest as bt
from panelforge.operators import cleaning as cl
from panelforge.operators import daily, joins, labels, model, scoring
from panelforge.operators import windows as w
from panelforge.plans import lint

D0 = dt.date(2020, 1, 1)


def bars(spark, n=120, symbols=2, seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for s in range(symbols):
        c = 100 * np.exp(np.cumsum(0.02 * r.standard_normal(n)))
        o = c * (1 + 0.005 * r.standard_normal(n))
        h, low = np.maximum(o, c) * (1 + 0.01 * r.random(n)), np.minimum(o, c) * (1 - 0.01 * r.random(n))
        v = r.integers(100, 1000, n)
        rows += [(s, D0 + dt.timedelta(days=i), *map(float, (o[i], h[i], low[i], c[i], v[i]))) for i in range(n)]
    return spark.createDataFrame(rows, "symbol int, ts date, open double, high double, low double, close double, volume double")


def test_null_safe_expressions(spark):
    d = spark.createDataFrame([("1.5", 0.0), ("x", 2.0), ("NaN", 1.0), ("inf", 1.0), (None, None)], "s string, b double")
    got = d.select(num(F.col("s")), div(F.lit(1.0), F.col("b")), flag(F.col("b") > 1), clip(F.col("b"), 0, 1)).collect()
    assert [tuple(g) for g in got] == [(1.5, None, 0, 0.0), (None, 0.5, 1, 1.0), (None, 1.0, 0, 1.0), (None, 1.0, 0, 1.0), (None, None, 0, None)]


def test_recursive_columns_equal_pandas(spark):
    x = [None, None, 3.0, 5.0, None, None, 2.0, 8.0, 8.0, 1.0]
    d = spark.createDataFrame([(1, D0 + dt.timedelta(days=i), v) for i, v in enumerate(x)], "symbol int, ts date, x double")
    got = w.recursive(d, {"e": ("ewm", "x", 0.3, 2), "r": ("rank", "x", 2)}).orderBy("ts").toPandas()
    s = pd.Series(x, dtype="float64")
    np.testing.assert_allclose(got.e.astype(float), s.ewm(alpha=0.3, adjust=False, min_periods=2).mean())
    np.testing.assert_allclose(got.r.astype(float), s.expanding(2).rank(pct=True))


def test_gates_count_known_values(spark):
    d = daily.oscillators(bars(spark, 40, 1)).orderBy("ts").toPandas()
    assert d.rsi14.first_valid_index() == 14 and d.atr14.first_valid_index() == 13 and d.adx14.first_valid_index() == 26


def test_rank_bucket_equals_qcut(spark):
    for n in (1, 2, 7, 30, 41):
        for q in (3, 5, 10):
            d = spark.createDataFrame([(i, float((i * 7) % n), 1) for i in range(n)], "symbol int, x double, k int")
            got = d.select("x", "symbol", agg.rank_bucket(F.col("x"), q, "k", ties=("symbol",)).alias("b")).orderBy("x", "symbol").toPandas()
            if n > 1:
                want = pd.qcut(got.x.rank(method="first"), q, labels=False) + 1
                assert got.b.tolist() == want.tolist()


def test_value_cut_drops_repeated_edges(spark):
    x = [1.0] * 6 + [2.0, 3.0, 4.0, 5.0]
    d = agg.with_value_bucket(spark.createDataFrame([(v,) for v in x], "x double"), "x", 5, "b").orderBy("x").toPandas()
    assert d.b.tolist() == (pd.qcut(pd.Series(x), 5, labels=False, duplicates="drop") + 1).tolist()


def test_asof_is_strict_and_equals_pandas(spark):
    t = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(hours=k)
    left = pd.DataFrame([(s, t(k)) for s in "ab" for k in range(0, 30, 2)], columns=["s", "ts"])
    right = pd.DataFrame([(s, t(k), float(k)) for s in "ab" for k in (4, 7, 8, 21)], columns=["s", "known", "v"])
    for strict in (True, False):
        got = joins.asof(spark.createDataFrame(left, "s string, ts timestamp_ntz"), spark.createDataFrame(right, "s string, known timestamp_ntz, v double"), "s", "ts", "known", ["v"], strict).orderBy("s", "ts").toPandas()
        want = pd.merge_asof(left.sort_values("ts"), right.sort_values("known"), left_on="ts", right_on="known", by="s", allow_exact_matches=not strict).sort_values(["s", "ts"])
        np.testing.assert_array_equal(got.v.astype(float), want.v)


def test_upsert_keeps_the_newest(spark):
    a = spark.createDataFrame([(1, 1, 10.0), (1, 2, 20.0)], "symbol int, ts int, x double")
    b = spark.createDataFrame([(1, 2, 21.0), (2, 1, 5.0)], "symbol int, ts int, x double")
    assert sorted(map(tuple, joins.upsert(a, b, ["symbol", "ts"]).collect())) == [(1, 1, 10.0), (1, 2, 21.0), (2, 1, 5.0)]


def test_normal_functions():
    assert stats.norm_cdf(0) == 0.5 and stats.norm_ppf(0.975) == pytest.approx(1.959964, abs=1e-6)
    assert stats.two_sided_p(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert 0 == stats.expected_max_t(1) < stats.expected_max_t(10) < stats.expected_max_t(1000)


def test_cdf_column(spark):
    for x, c in spark.range(-40, 41).select((F.col("id") / 10).alias("x")).select("x", stats.cdf(F.col("x"))).collect():
        assert c == pytest.approx(stats.norm_cdf(x), abs=1e-7)


def xs_panel(spark, signal, days=60, names=40, seed=3):
    r = np.random.default_rng(seed)
    rows = []
    for k in range(days):
        y = r.standard_normal(names)
        x = {"same": y, "opposite": -y, "noise": r.standard_normal(names), "weak": y + 2 * r.standard_normal(names)}[signal]
        rows += [("f", D0 + dt.timedelta(days=k), i, float(x[i]), float(y[i])) for i in range(names)]
    return spark.createDataFrame(rows, "feature string, ts date, symbol int, x double, y double")


def test_daily_ic(spark):
    for signal, want in (("same", 1.0), ("opposite", -1.0)):
        assert all(r.ic == pytest.approx(want) for r in scoring.daily_ic(xs_panel(spark, signal, 5), "y", 30).collect())
    assert all(r.ic is None for r in scoring.daily_ic(xs_panel(spark, "same", 5), "y", 41).collect())
    flat = spark.createDataFrame([("f", D0, i, 1.0, float(i)) for i in range(40)], "feature string, ts date, symbol int, x double, y double")
    assert scoring.daily_ic(flat, "y", 30).first().ic is None


def test_newey_west(spark):
    x = np.cumsum(np.random.default_rng(0).standard_normal(80)) * 0.1 + 1
    d = spark.createDataFrame([("f", i, float(v)) for i, v in enumerate(x)], "feature string, ts int, ic double")
    plain = scoring.newey_west(d, "ic", 0, "feature").first().t
    assert plain == pytest.approx(x.mean() / (x.std() / math.sqrt(80)))
    assert abs(scoring.newey_west(d, "ic", 5, "feature").first().t) < abs(plain)


def test_long_short_and_folds(spark):
    good = scoring.long_short(xs_panel(spark, "weak"), "x", "y", 2, 5, 30).toPandas()
    assert good.gross.mean() > 0.3 and (good.drawdown <= 0).all() and (good.turnover.between(0, 1)).all()
    ic = scoring.daily_ic(xs_panel(spark, "same"), "y", 30)
    assert scoring.fold_signs(ic, 4, 2).first().agree == 1.0


def test_drawdown(spark):
    eq = spark.createDataFrame([(1, D0 + dt.timedelta(days=i), v, 1, 1, 1) for i, v in enumerate([1.0, 1.2, 0.6, 0.9, 1.3])], "k int, ts date, equity double, held int, taken int, won int")
    got = bt.equity_stats(eq, ["k"], 2).first()
    r = np.diff([1.0, 1.0, 1.2, 0.6, 0.9, 1.3]) / [1.0, 1.0, 1.2, 0.6, 0.9]
    assert got.max_drawdown == pytest.approx(-0.5) and got.exposure == 0.5 and got.win_rate == 1
    assert got.sharpe == pytest.approx(r.mean() / r.std() * 252 ** 0.5) and got.growth == pytest.approx(1.3 ** (252 / 5) - 1)
    fall = spark.createDataFrame([(1, D0, 0.8, 1, 1, 0)], "k int, ts date, equity double, held int, taken int, won int")
    assert bt.equity_stats(fall, ["k"], 1).first().max_drawdown == pytest.approx(-0.2)


def test_clusters_and_redundancy():
    pairs = [("a", "b", 0.9), ("b", "c", -0.86), ("d", "e", 0.5)]
    assert scoring.clusters(pairs, 0.85) == [["a", "b", "c"]]
    assert scoring.without_redundant(["a", "b", "d"], {("a", "b"): 0.95}) == ["a", "d"]


def test_barrier_by_hand(spark):
    def trade(hr, lr, cr):
        n = len(hr)
        d = spark.createDataFrame([(hr, lr, cr, [D0] * n)], "hr array<double>, lr array<double>, cr array<double>, ahead array<date>")
        r = bt.barrier(d, F.lit(5.0), F.lit(3.0), n).first()
        return r.outcome, r.exit_bar, round(r.ret, 6), round(r.mfe, 6), round(r.mae, 6)

    assert trade([1.01, 1.06, 1.2], [0.99, 1.0, 0.5], [1.0, 1.05, 0.6]) == ("TP", 2, 5.0, 6.0, -1.0)
    assert trade([1.06, 1.0, 1.0], [0.96, 1.0, 1.0], [1.0, 1.0, 1.0]) == ("SL", 1, -3.0, 6.0, -4.0)
    assert trade([1.01, 1.02, 1.01], [0.99, 0.98, 0.99], [1.0, 1.0, 1.007]) == ("TIME", 3, 0.7, 2.0, -2.0)


DAYS = [D0 + dt.timedelta(days=k) for k in range(30)]
TRADE = "k int, symbol int, score double, ret double, exit_bar int, cr array<double>, ahead array<date>"


def test_slots_are_free_a_day_later(spark):
    path = lambda first, n: [DAYS[first + i] for i in range(n)]
    rows = [(1, 1, 9.0, 10.0, 2, [1.05, 1.2, 1.0], path(1, 3)), (1, 2, 8.0, 50.0, 1, [1.5], path(1, 1)), (1, 3, 7.0, 50.0, 1, [1.5], path(2, 1)), (1, 4, 7.0, 20.0, 1, [1.1], path(4, 1))]
    dates = spark.createDataFrame([(d,) for d in DAYS], "ts date")
    got = bt.slots(spark.createDataFrame(rows, TRADE), dates, 1, ["k"], cost=1.0).orderBy("ts").collect()
    assert [(r.ts, r.taken, r.held, round(r.equity, 6)) for r in got] == [(DAYS[1], 1, 1, 1.05), (DAYS[2], 0, 1, 1.1), (DAYS[3], 0, 0, 1.09), (DAYS[4], 1, 1, round(1.09 * 1.2, 6))]


def test_slots_as_a_plain_book(spark):
    """Day by day with dictionaries, no classes: sleeves, marks, costs, gaps."""
    r = np.random.default_rng(3)
    rows = []
    for i in range(60):
        first, n = int(r.integers(0, 20)), int(r.integers(1, 6))
        ahead = sorted(r.choice(np.arange(first, first + 9), n, replace=False).tolist())
        rows.append((i % 2, i, float(r.integers(0, 9)), float(r.normal(0, 5)), n, r.uniform(0.9, 1.1, n).tolist(), [DAYS[x] for x in ahead]))
    dates = spark.createDataFrame([(d,) for d in DAYS], "ts date")
    got = {(x.k, x.ts): (x.taken, x.won, x.held, x.equity) for x in bt.slots(spark.createDataFrame(rows, TRADE), dates, 3, ["k"], 2, 0.5).collect()}
    want = {}
    for key in (0, 1):
        mine = sorted((x for x in rows if x[0] == key), key=lambda x: (-x[2], x[1]))
        cash, held = {i: 1 / 3 for i in range(3)}, {}
        first = min(x[6][0] for x in mine)
        for day in [d for d in DAYS if first <= d <= max(x[6][-1] for x in mine)]:
            room = [i for i in range(3) if i not in held][:2]
            new = [x for x in mine if x[6][0] == day][:len(room)]
            held |= dict(zip(room, new))
            worth = 0
            for i in range(3):
                m = 1.0
                if i in held:
                    seen = [k for k, d in enumerate(held[i][6]) if d <= day]
                    m = 1 + held[i][3] / 100 if seen[-1] == len(held[i][6]) - 1 else held[i][5][seen[-1]]
                worth += cash[i] * m
            want[key, day] = (len(new), sum(x[3] > 0.5 for x in new), len(held), worth)
            for i in [i for i in held if held[i][6][-1] == day]:
                cash[i] *= 1 + (held.pop(i)[3] - 0.5) / 100
    assert got.keys() == want.keys()
    assert all(got[k][:3] == want[k][:3] and got[k][3] == pytest.approx(want[k][3]) for k in want)


def test_market_regime_is_known_the_day_before(spark):
    """A date's own prices change nothing in its row."""
    b = bars(spark, 80, 6)
    last = D0 + dt.timedelta(days=79)
    wild = b.withColumn("close", F.when(F.col("ts") == last, F.col("close") * (1 + F.col("symbol"))).otherwise(F.col("close")))
    rows = [{r.ts: r for r in labels.market_regime(x).collect()} for x in (b, wild)]
    assert rows[0] == rows[1] and rows[0][last].trend is not None
    later = [{r.ts: r for r in labels.market_regime(x.unionByName(x.where(F.col("ts") == last).withColumn("ts", F.date_add("ts", 1)))).collect()}[last + dt.timedelta(days=1)] for x in (b, wild)]
    assert later[0].dispersion != later[1].dispersion


def test_regime_bias_and_strict_by_hand(spark):
    d = spark.createDataFrame([(1, DAYS[0], 11.0, 10.0, 19.9), (1, DAYS[1], 9.0, 10.0, 20.0), (1, DAYS[2], 11.0, None, None)], "symbol int, ts date, close double, sma200 double, adx14 double")
    got = labels.stock_regime(d).orderBy("ts").collect()
    assert [(r.regime, r.regime_lag) for r in got] == [("bull_range", "bull_trend"), ("bear_trend", "bull_range"), ("bear_trend", "bear_trend")]
    assert got[0].regime_dist_sma200 == pytest.approx(0.1) and got[2].regime_bull_soft is None
    d = spark.createDataFrame([(60.0, 5.0, 100.0, -1.5), (40.0, 1.0, 100.0, 0.1), (None, None, 100.0, None)], "rsi14 double, atr14 double, close double, cpr_width_pct double")
    assert [(round(r.long_score, 6), round(r.short_score, 6)) for r in labels.bias(d).collect()] == [(0.2, -0.8), (0.0, 1.0), (0.0, 0.0)]
    rows = [(1, DAYS[i], c, low, label) for i, (c, low, label) in enumerate([(100.0, 99.0, 1), (100.0, 98.0, 1), (90.0, 96.0, 0), (101.0, 99.0, None), (100.0, 99.0, 1)])]
    d = spark.createDataFrame(rows, "symbol int, ts date, close double, low double, label int")
    assert [r.x for r in d.select("ts", labels.strict_label(d, 3, 5.0).alias("x")).orderBy("ts").collect()] == [1, 1, 0, None, None]


def test_verdicts_and_advice(spark):
    f = lambda *v: spark.range(1).select(scoring.feature_verdict(*[F.lit(x).cast("double") for x in v]).alias("x")).first().x
    assert f(None, 3, 1, 1, 1, 1) == "insufficient_data" and f(2, 3, 1, 1, 1, 1).startswith("noise") and f(4, 3, 0, 1, 1, 1) == "fails net-of-cost"
    assert f(4, 3, None, 0.5, 1, 1) == "unstable across folds" and f(-4, 3, 1, None, 0.1, -0.1) == "decays out-of-sample" and f(4, 3, 1, 0.6, None, 1) == "CANDIDATE"
    g = lambda *v: spark.range(1).select(scoring.strategy_verdict(*[F.lit(x).cast("double") for x in v]).alias("x")).first().x
    assert g(9, 3, 0.6, 1, 1, 1, 1, 1, 1).startswith("AVOID") and g(9, 3, 0.1, 7, 1, 1, 1, 1, 1).startswith("AVOID") and g(None, 3, 0.1, 1, 1, 1, 1, 1, 1) == "NO_EDGE"
    assert g(4, 3, 0.1, 1, 1.0, 0.9, 0.6, None, 1) == "STRONG" and g(4, 3, 0.1, 1, 0.4, 0.9, 0.6, 1, 1) == "PROMISING" and g(4, 3, 0.1, None, None, 0.9, 0.6, 1, 1) == "MARGINAL"
    assert g(4, 3, 0.1, 1, 2, 0.95, 0.9, -1, 1) == "MARGINAL" and g(4, 3, 0.1, 1, 2, 0.95, 0.5, 1, 1) == "MARGINAL"
    rows = [("harm", 0.5, [0.1, -0.001], [0.5], 0.5), ("one", 0.0, [0.003, None], [], 0.0), ("ic", None, [None], [-0.04], 0.0), ("all", 0.003, [], [], 0.0), ("dead", 0.0, [0.0, 0.0005], [0.01], 0.01), ("unsure", 0.0, [], [None], 0.0), ("weak", 0.0015, [0.0], [0.0], 0.0)]
    d = spark.createDataFrame(rows, "f string, a double, b array<double>, c array<double>, d double")
    assert {r.f: r.x for r in d.select("f", model.recommend(*map(F.col, "abcd")).alias("x")).collect()} == {
        "harm": "DROP_HARMFUL", "one": "KEEP", "ic": "KEEP", "all": "KEEP", "dead": "DROP", "unsure": "REVIEW", "weak": "REVIEW"}


def test_names_and_dates(spark):
    raw = ["\ufeff ab c\t d\n", "Symbol", " <>: ", None, "x/y?*z", " Nse-EQ "]
    d = spark.createDataFrame([(x,) for x in raw], "s string")
    assert [r.x for r in d.select(cl.clean_symbol(F.col("s")).alias("x")).collect()] == ["ab c d", None, None, None, "xyz", "Nse-EQ"]
    text = ["2020-01-02", "2-1-2020", "02/01/2020", "12/25/2020", "02.01.2020", "20200102", "", None]
    d = spark.createDataFrame([(x,) for x in text], "s string")
    jan = dt.date(2020, 1, 2)
    assert [r.x for r in d.select(cl.parse_date(F.col("s")).alias("x")).collect()] == [jan, jan, jan, dt.date(2020, 12, 25), jan, None, None, None]
    r = spark.range(1).select(*[v.alias(k) for k, v in cl.date_range(F.lit("2030-01-01"), F.lit("2020-01-02"), F.lit(dt.date(2025, 5, 5))).items()]).first()
    assert (r["first"], r["last"]) == (jan, dt.date(2025, 5, 5))


def test_columns_left_out(spark):
    d = spark.createDataFrame([(1, 2, 3)], "a int, ret_5d int, c int")
    assert cl.without(d, ("a", "z"), ("^ret_",)).columns == ["c"] and cl.narrowed(d.select(F.col("a").cast("double"))).dtypes == [("a", "float")]


def test_splits_are_ordered_and_embargoed(spark):
    d = spark.createDataFrame([(D0 + dt.timedelta(days=i), s) for i in range(100) for s in range(2)], "ts date, symbol int")
    p = labels.three_way(d, embargo=5).toPandas().groupby("part").ts.agg(["min", "max"])
    assert (p.loc["cal", "min"] - p.loc["train", "max"]).days == 6 and (p.loc["test", "min"] - p.loc["cal", "max"]).days == 6
    for _, f in labels.expanding_folds(d, 4, 3).toPandas().groupby("fold"):
        assert (f[f.part == "test"].ts.min() - f[f.part == "train"].ts.max()).days == 4
    for _, f in labels.purged_folds(d, 4, 3).toPandas().groupby("fold"):
        test, train = f[f.part == "test"].ts, f[f.part == "train"].ts
        assert min(abs((a - b).days) for a in (test.min(), test.max()) for b in train) == 4


def test_thin_cross_section_has_no_class_zero(spark):
    d = spark.createDataFrame([(D0, i, float(i)) for i in range(4)], "ts date, symbol int, y double").withColumn("r", w.xs_rank(F.col("y"), "ts"))
    assert d.where("r <= 0.2").count() == 0 and d.where("r >= 0.8").count() == 1


def test_one_class_is_not_fitted(spark):
    d = spark.createDataFrame([(1.0, 1), (2.0, 1), (3.0, None)], "x double, label int")
    assert model.member(d, ["x"], "label", 1) is None


@pytest.mark.parametrize("build", [daily.oscillators, daily.money_flow, daily.narrow_range, daily.averages, daily.balance_volume, daily.bands, daily.candles, daily.weekly, daily.week_node,
                                   lambda d: daily.structure(daily.pivots(d)), lambda d: daily.alphas(d), lambda d: daily.transforms(d, "close"), lambda d: labels.stock_regime(daily.averages(daily.oscillators(d))),
                                   lambda d: labels.featurised(daily.combos(daily.structure(daily.pivots(daily.balance_volume(daily.oscillators(d)))))),
                                   lambda d: daily.structural(daily.bands(daily.structure(daily.pivots(daily.oscillators(d)))))])
def test_the_past_does_not_know_the_future(spark, build):
    assert lint.leaks(build, bars(spark, 110), D0 + dt.timedelta(days=95)) == []


def test_the_canary_sees_a_leak(spark):
    b = bars(spark, 60)
    assert lint.leaks(lambda d: d.select("symbol", "ts", w.whole_rank(F.col("close")).alias("x")), b, D0 + dt.timedelta(days=50)) == ["x"]
    assert lint.leaks(lambda d: d.select("symbol", "ts", w.lead(F.col("close"), 3).alias("x")), b, D0 + dt.timedelta(days=50)) == ["x"]


def test_the_lint_sees_forward_windows(spark):
    b = bars(spark, 10)
    assert lint.forward_windows(b.select(w.forward_high(F.col("high"), 3))) and not lint.forward_windows(b.select(w.mean(F.col("high"), 3)))


def test_cleaning(spark):
    d = bars(spark, 30).withColumns({"D_a": F.col("close"), "D_b": F.lit(1.0), "D_fwd": F.col("close"), "x": F.col("close")})
    assert cl.discover(d, ("D_",), ("fwd",)) == ["D_a"]
    assert cl.unique_names(["a", "b", "a", "a"]) == ["a", "b", "a__dup1", "a__dup2"]
    assert cl.pick_column(["Symbol", "Date"], ["ticker", "SYMBOL"]) == "Symbol"
    with pytest.raises(ValueError):
        cl.no_labels(["D_a", "ret_5d_oc"])
    cl.no_labels(["D_a"])
    twice = bars(spark, 5, 1).unionByName(bars(spark, 1, 1))
    assert cl.monotonic_errors(twice).count() == 1


def test_held_book_by_hand(spark):
    """Two names, one place: costs of a change, unknown returns, a day off."""
    day = [D0 + dt.timedelta(days=i) for i in range(5)]
    rows = [("a", day[0], 10.0, 10.0, 2.0), ("a", day[1], 10.0, 12.0, 1.0), ("a", day[2], 12.0, 15.0, 1.0), ("a", day[3], 15.0, 15.0, 1.0), ("a", day[4], 15.0, 15.0, None)]
    rows += [("b", d, 20.0, 20.0, 1.5 if i == 1 else None) for i, d in enumerate(day)]
    got = bt.held_top_k(spark.createDataFrame(rows, "symbol string, ts date, open double, close double, score double"), "score", 1, 1, 0.01).orderBy("ts").collect()
    assert [(r.ts, r.n, r.added, r.turnover) for r in got] == [(day[0], 1, 1, 1.0), (day[1], 1, 1, 1.0), (day[2], 1, 1, 1.0), (day[3], 1, 0, 0.0)]
    want = [15 / 10 - 1 - 0.01, 0.0 - 0.01, 15 / 15 - 1 - 0.01, 0.0]
    np.testing.assert_allclose([r.pnl for r in got], want, atol=1e-12)
    np.testing.assert_allclose([r.equity for r in got], np.cumprod(1 + np.array(want)))


def test_a_book_that_loses_all_ends(spark):
    rows = [("a", D0 + dt.timedelta(days=i), 10.0, 10.0 if i < 2 else 0.0, 1.0) for i in range(5)]
    got = bt.held_top_k(spark.createDataFrame(rows, "symbol string, ts date, open double, close double, score double"), "score", 1, 1, 0.0).orderBy("ts").collect()
    assert got[0].equity is None and all(r.equity is None for r in got)
    assert bt.held_top_k(spark.createDataFrame(rows, "symbol string, ts date, open double, close double, score double").where("false"), "score", 1, 1, 0.0).count() == 0
