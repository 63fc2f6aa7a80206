"""The factory's grouped summaries equal the columns they stand for."""

import numpy as np
from pyspark.sql import functions as F

from panelforge.operators import candidates as cand
from panelforge.operators import windows as w
from panelforge.plans import research
from tests.test_units import bars

C = F.col


def test_summaries_equal_the_transforms(spark):
    b = bars(spark, 70).unionByName(bars(spark, 29, 1).withColumn("symbol", F.lit(9)))
    b = b.withColumns({"x": F.when(F.dayofmonth("ts") % 7 != 0, F.round("volume", -2)), "flat": F.lit(3.3), "none": F.lit(None).cast("double")})
    d, made = cand.generate(b, ["x", "flat", "none"])
    names = [*made, "close"]
    want = d.agg(*[F.count(k).alias(f"{k}|n") for k in names], *[F.sum(k).alias(f"{k}|t") for k in names]).first()
    got = {r.feature: r for r in cand.summaries(b.repartition(5), ["x", "flat", "none"], ["close"]).collect()}
    assert set(got) == {k for k in names if want[f"{k}|n"]}
    for k, r in got.items():
        assert r.n == want[f"{k}|n"], k
        np.testing.assert_allclose(r.total, want[f"{k}|t"], rtol=1e-9, atol=1e-9, err_msg=k)
    assert got["flat_rstd50"].total == 0
    assert cand.summaries(b.where("false"), ["x"]).count() == 0


def test_the_query_writes_no_long_rows(spark, monkeypatch):
    monkeypatch.setattr(research.s, "long_form", lambda *a, **k: 1 / 0)
    monkeypatch.setattr(research.bars, "supplier_days", lambda *a: bars(spark, 120))
    got = research.m24_factory(spark, "").collect()
    assert len({r.feature for r in got}) == len(got) > 400 and all(r.n > 0 for r in got)


def test_rolled_equals_the_window_frames(spark):
    b = bars(spark, 90).withColumn("x", F.when(F.dayofmonth("ts") % 5 != 0, F.round("volume", -2)))
    d = w.recursive(b, {"t": ("total", "x", 60, 20), "m": ("mean", "x", 30, 9), "r": ("ts_rank", "x", 20, 10)})
    p = d.withColumns({"t2": w.total(C("x"), 60, 20), "m2": w.mean(C("x"), 30, 9), "r2": w.ts_rank(C("x"), 20)}).toPandas()
    assert p[["t", "m", "r"]].notna().any().all()
    for k in "tmr":
        np.testing.assert_allclose(p[k].astype(float), p[f"{k}2"].astype(float), rtol=1e-12)


def test_rolled_and_ranks_over_many_blocks(monkeypatch):
    x = np.round(np.random.default_rng(2).normal(size=700), 1)
    x[::9] = np.nan
    want = [w.rolled(x, 50, 10, k) for k in ("total", "mean", "ts_rank")]
    rank = w.expanding_rank(x, 60)
    assert np.isnan(rank[:60]).all() and rank[-1] == ((x < x[-1]).sum() + ((x == x[-1]).sum() + 1) / 2) / (x == x).sum()
    monkeypatch.setattr(w, "ROLL_BLOCK", 7)
    monkeypatch.setattr(w, "RANK_BLOCK", 5)
    for k, y in zip(("total", "mean", "ts_rank"), want, strict=True):
        np.testing.assert_allclose(w.rolled(x, 50, 10, k), y, rtol=1e-12)
    np.testing.assert_array_equal(w.expanding_rank(x, 60), rank)
