"""The candidate factory against plain pandas, and its past against its future."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelforge.operators import candidates as cand
from panelforge.operators import windows as w
from panelforge.plans import lint
from tests.test_units import D0, bars

NAMES = [f"f{i}" for i in cand.ALPHAS]


def brute(p: pd.DataFrame) -> pd.DataFrame:
    """One symbol's alphas, formula by formula."""
    o, h, low, c, v = (p[k].astype(float) for k in ("open", "high", "low", "close", "volume"))
    ret, adv = c.pct_change(fill_method=None), v.rolling(20, min_periods=5).mean()

    def r(x):
        return x.expanding(60).rank(pct=True)

    def scale(x):
        return x / x.abs().expanding().sum()

    def greatest(x):
        return np.nanargmax(x) / (len(x) - 1) - 0.5

    tr = lambda x, n: x.rolling(n, min_periods=max(3, n // 2)).rank(pct=True)
    corr = lambda a, b, n, k=None: a.rolling(n, min_periods=k or max(5, n // 2)).corr(b).replace([np.inf, -np.inf], np.nan)
    under, power, back = (h + low + c) / 3 - c, np.sign(ret) * ret.abs() ** 2, c.shift(20).diff(10) / 10
    total = lambda n, k: ret.rolling(n, min_periods=k).sum()
    low5, short = low.rolling(5, min_periods=3).min(), total(20, 5)
    return pd.DataFrame({
        "f1": power.rolling(5, min_periods=3).apply(greatest, raw=True), "f7": (-tr(c.diff(7).abs(), 60) * np.sign(c.diff(7))).where(adv < v, -1.0),
        "f11": r(under.rolling(3).max()) + r(under.rolling(3).min()) * r(v.diff(3)), "f14": -r(ret.diff(3)) * corr(o, v, 10),
        "f15": -r(corr(r(h), r(v), 3, 3)).rolling(3, min_periods=1).sum(), "f24": c.rolling(100, min_periods=50).mean() / c.shift(100) - 1,
        "f28": scale(corr(adv, low, 5)) + scale(c - o), "f34": r((1 - r(ret.rolling(2).std())) + (1 - r(corr(c, o, 5)))),
        "f43": tr(v / adv, 20) * tr(-c.diff(7), 8), "f46": np.where((c.shift(20) - c.shift(10)) / 10 - (c.shift(10) - c) / 10 > 0.25, -1.0, 1.0),
        "f49": np.where(back > 0.1, -1.0, -c.diff()), "f51": np.where(back > 0.05, -1.0, -c.diff()),
        "f52": (low5.shift(5) - low5) * r((total(240, 50) - short) / short), "f53": -(1 - (h - c) / (c - low)).diff(9),
        "f54": -(low - c) * o ** 5 / ((low - h) * c ** 5), "f56": -(r(total(10, 3) / total(2, 1).rolling(3, min_periods=1).sum()) * r(ret * c * v)),
        "f101": (c - o) / (h - low + 0.001)})


def test_every_alpha_equals_brute_force(spark):
    b = bars(spark, 280)
    got = cand.alphas(b).orderBy("symbol", "ts").toPandas()
    for s, p in b.orderBy("symbol", "ts").toPandas().groupby("symbol"):
        mine, want = got[got.symbol == s].reset_index(drop=True), brute(p.reset_index(drop=True))
        for a in NAMES:
            assert want[a].notna().sum() > 50, a
            np.testing.assert_allclose(mine[a].astype(float), want[a], atol=1e-7, err_msg=a)


def test_every_transform_equals_pandas(spark):
    b = bars(spark, 70).withColumn("x", F.when(F.dayofmonth("ts") % 7 != 0, F.round("volume", -2)))
    d, made = cand.generate(b, ["x"])
    got = d.orderBy("symbol", "ts").toPandas()
    assert len(made) == 14
    for s, p in got.groupby("symbol"):
        x = p.x.astype(float)
        want = {f"x_lag{n}": x.shift(n) for n in (1, 3, 5)} | {f"x_diff{n}": x.diff(n) for n in (1, 5)}
        for n in (10, 20, 50):
            roll = x.rolling(n, min_periods=max(3, n // 4))
            want |= {f"x_rmean{n}": roll.mean(), f"x_rstd{n}": roll.std(), f"x_rrank{n}": roll.rank(pct=True)}
        assert sorted(want) == sorted(made)
        for k, y in want.items():
            np.testing.assert_allclose(p[k].astype(float), y, atol=1e-8, err_msg=f"{s} {k}")


def test_short_symbols_are_left_out(spark):
    b = bars(spark, 30).unionByName(bars(spark, 29, 1).withColumn("symbol", F.lit(9)))
    assert {r.symbol for r in cand.generate(b, ["close"])[0].select("symbol").distinct().collect()} == {0, 1}
    assert cand.generate(b.where("false"), ["close"])[0].count() == 0


def test_base_columns_have_values_and_no_future(spark):
    assert len(cand.BASE) == 32
    b, since = bars(spark, 200), D0 + dt.timedelta(days=180)
    row = cand.base(b).agg(*[F.count(c).alias(c) for c in cand.BASE]).first()
    assert all(row[c] > 0 for c in cand.BASE)
    assert lint.leaks(cand.base, b, since) == []
    assert lint.leaks(cand.alphas, b, since) == []


def test_grouped_columns_keep_rows_and_types(spark):
    """Null keys, repeated times and other columns come through once."""
    d = spark.createDataFrame([(None, D0, 1.0, [1]), (1, D0, 2.0, None), (1, D0, 2.0, [2, 3]), (1, D0 + dt.timedelta(days=1), None, [])], "symbol int, ts date, x double, other array<int>")
    got = w.recursive(d, {"r": ("rank", "x", 1)})
    assert dict(got.dtypes) == dict(d.dtypes) | {"r": "double"}
    assert sorted(map(str, got.select(*d.columns).collect())) == sorted(map(str, d.collect()))
    assert w.recursive(d.where("false"), {"r": ("rank", "x", 1)}).count() == 0
