"""The sixteen daily alphas against plain pandas, with values in every one."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import daily
from panelforge.plans import lint, registry
from tests.test_units import D0, bars

NAMES = [f"a{i}" for i in (3, 6, 12, 13, 16, 19, 20, 23, 26, 29, 33, 35, 38, 40, 41, 44)]


def brute(p: pd.DataFrame) -> pd.DataFrame:
    """One symbol's alphas, formula by formula (SURVEY, Appendix B)."""
    o, h, low, c, v = (p[k].astype(float) for k in ("open", "high", "low", "close", "volume"))
    ret = c.pct_change(fill_method=None)

    def r(x):
        return pd.Series([np.nan if np.isnan(x.iloc[i]) or (s := x.iloc[:i + 1].dropna()).size < 60 else ((s < x.iloc[i]).sum() + ((s == x.iloc[i]).sum() + 1) / 2) / s.size for i in range(len(x))], x.index)

    tr = lambda x, n: x.rolling(n, min_periods=max(3, n // 2)).rank(pct=True)
    corr = lambda a, b, n: a.rolling(n, min_periods=max(5, n // 2)).corr(b)
    cov = lambda a, b: a.rolling(5, min_periods=3).cov(b)
    return pd.DataFrame({
        "a3": -corr(r(o), r(v), 10), "a6": -corr(o, v, 10), "a12": np.sign(v.diff()) * -c.diff(), "a13": -r(cov(r(c), r(v))), "a16": -r(cov(r(h), r(v))),
        "a19": -np.sign((c - c.shift(7)).diff(5) + c.diff(5)) * (1 + r(1 + ret.rolling(250, min_periods=50).sum())),
        "a20": -r(o - h.shift(1)) * r(o - c.shift(1)) * r(o - low.shift(1)), "a23": (-h.diff(2)).where(h.rolling(20, min_periods=10).mean() < h, 0.0),
        "a26": -corr(tr(v, 5), tr(h, 5), 5).replace([np.inf, -np.inf], np.nan).rolling(3, min_periods=3).max(), "a29": r(r(-r(c.diff(5)))), "a33": r(-1 + o / c),
        "a35": tr(v, 32) * (1 - tr(c + h - low, 16)) * (1 - tr(ret, 32)), "a38": -r(tr(c, 10)) * r(c / o), "a40": -r(h.rolling(10, min_periods=5).std()) * corr(h, v, 10),
        "a41": np.sqrt(h * low) - (h + low + c) / 3, "a44": -corr(h, r(v), 5)})


def test_every_alpha_equals_brute_force(spark):
    b = bars(spark, 260)
    got = daily.alphas(b).orderBy("symbol", "ts").toPandas()
    for s, p in b.orderBy("symbol", "ts").toPandas().groupby("symbol"):
        mine, want = got[got.symbol == s].reset_index(drop=True), brute(p.reset_index(drop=True))
        for a in NAMES:
            assert want[a].notna().sum() > 50, a
            np.testing.assert_allclose(mine[a].astype(float), want[a], atol=1e-8, err_msg=a)


def test_the_past_does_not_know_the_future(spark):
    b, since = bars(spark, 220), D0 + dt.timedelta(days=200)
    row = daily.alphas(b).where(F.col("ts") < F.lit(since)).agg(*[F.count(a).alias(a) for a in NAMES]).first()
    assert all(row[a] > 0 for a in NAMES)
    assert lint.leaks(daily.alphas, b, since) == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_the_query_has_values_of_every_alpha(spark, sf):
    row = registry.queries()["d28_alphas"](spark, f"/root/testdata/{sf}").agg(F.count("*").alias("n"), *[F.count(a).alias(a) for a in NAMES]).first()
    assert {a: row[a] for a in NAMES if row[a] < row.n / 2} == {}
