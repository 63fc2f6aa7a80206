"""The factory in one pass: equal to the columns it stands for, and no rows moved twice."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelforge.operators import candidates as cand
from panelforge.operators import windows as w
from panelforge.plans import research
from panelforge.sources import bars as sources
from tests.test_units import D0, bars

C = F.col
NAMES = [f"f{i}" for i in cand.ALPHAS]


def odd(spark):
    """Gaps of days, a flat symbol, repeated prices, unknown and zero values, an
    unknown symbol, and symbols of 30 and 29 bars."""
    b = bars(spark, 260, 4).where("dayofmonth(ts) % 9 != 4 or symbol = 1")
    b = b.withColumns({k: F.when(C("symbol") == 0, 7.5).when(C("symbol") == 3, F.round(k)).otherwise(C(k)) for k in ("open", "high", "low", "close")})
    b = b.withColumn("volume", F.when((C("symbol") == 2) & (F.dayofmonth("ts") % 5 == 0), None).when(F.dayofmonth("ts") % 7 == 0, 0.0).otherwise(C("volume")))
    for k, n in (("close", 6), ("high", 8), ("open", 11), ("low", 13)):
        b = b.withColumn(k, F.when((C("symbol") == 2) & (F.dayofmonth("ts") == n), None).when((C("symbol") == 1) & (F.dayofmonth("ts") == n), 0.0).otherwise(C(k)))
    few = bars(spark, 30, 1, 5).withColumn("symbol", F.lit(8)).unionByName(bars(spark, 29, 1, 6).withColumn("symbol", F.lit(9)))
    return b.unionByName(few).unionByName(bars(spark, 90, 1, 7).withColumn("symbol", F.lit(None).cast("int")))


@pytest.mark.parametrize("batch", ["10000", "37"])
def test_factory_equals_the_columns(spark, monkeypatch, batch):
    b = odd(spark)
    want = {r.feature: r for r in cand.summaries(cand.base(cand.alphas(b)), list(cand.BASE), NAMES).collect()}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r.feature: r for r in cand.factory(b.repartition(5)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert set(got) == set(want) and len(want) == 32 * 14 + 17
    for k, r in got.items():
        assert r.n == want[k].n, k
        np.testing.assert_allclose(r.total, want[k].total, rtol=1e-7, atol=1e-7, err_msg=k)
    assert cand.factory(b.where("symbol = 9")).count() == 0


def test_the_query_exchanges_its_rows_once(spark, tmp_path):
    """Rows go by symbol once and sums by feature; no joins, no wide rows."""
    r = np.random.default_rng(3)
    rows = [(s, dt.datetime(2020, 1, 1) + dt.timedelta(days=int(r.integers(0, 60))), float(r.integers(100, 999)), float(r.integers(1, 9)), i, 1, 1) for s in range(3) for i in range(120)]
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate timestamp, l_extendedprice double, l_quantity double, l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    q = research.m24_factory(spark, str(tmp_path))
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan
    assert plan.count("Exchange hashpartitioning(symbol") == 1 and "FlatMapGroups" not in plan
    b = sources.supplier_days(spark, str(tmp_path))
    assert sorted(b.collect()) == sorted(sources.supplier_days(spark, str(tmp_path), "symbol").collect())
    want = cand.summaries(cand.base(cand.alphas(b)), list(cand.BASE), NAMES).collect()
    got = {x.feature: x for x in q.collect()}
    assert set(got) == {x.feature for x in want}
    for x in want:
        assert got[x.feature].n == x.n, x.feature
        assert abs(got[x.feature]["mean"] - x.total / x.n) <= 6e-5 + 1e-7 * abs(x.total / x.n), x.feature


def test_ranks_equal_the_expanding_rank(monkeypatch):
    r = np.random.default_rng(4)
    x, y = np.round(r.normal(size=(2, 700, 3)), 1)
    x[::9] = y[:, 1] = np.nan
    want = [np.column_stack([w.expanding_rank(c.copy(), 60) for c in z.T]) for z in (x, y)]
    for rows in (2000, 100):
        monkeypatch.setattr(cand, "RANK_ROWS", rows)
        for a, b in zip(cand._ranks(x, y), want, strict=True):
            np.testing.assert_array_equal(a, b)


def test_batches_are_cut_between_symbols(monkeypatch):
    monkeypatch.setattr(cand, "BLOCK", 20)
    i = np.concatenate([np.arange(1, n + 1) for n in (3, 50, 1, 7, 20, 9)])
    for size in (1, 7, 19, 200):
        parts = [pa.RecordBatch.from_pydict({"_i": i[a:a + size]}) for a in range(0, len(i), size)]
        got = [t["_i"].to_numpy() for t in cand._whole_symbols(iter(parts))]
        assert all(t[0] == 1 for t in got) and np.concatenate(got).tolist() == i.tolist()
    assert not list(cand._whole_symbols(iter([])))
    first, rows = np.array([0, 3, 53, 54, 61, 81]), np.array([3, 50, 1, 7, 20, 9])
    blocks = list(cand._blocks(first, rows, 3))
    assert [b.tolist() for _, b in blocks] == [[50], [20], [9, 7], [3]] and [a.tolist() for a, _ in blocks] == [[3], [61], [81, 54], [0]]


def test_a_day_is_in_the_week_that_ends_on_its_friday(spark):
    from panelforge.operators import daily
    d = spark.createDataFrame([(D0 + dt.timedelta(days=i),) for i in range(15)], "ts date")
    for x in d.select(F.unix_date("ts").alias("d"), F.unix_date(daily.week_end(C("ts"))).alias("k")).collect():
        assert x.d + (1 - x.d) % 7 == x.k
