"""Selection fits its trees on counts of equal rows: as MLlib does on the rows."""

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from panelforge.operators import model
from tests.test_models import planted


def test_selection_fits_on_counted_cells(spark, monkeypatch):
    monkeypatch.setattr(model, "member", lambda *a, **k: pytest.fail("fitted row by row"))
    d = planted(spark, 24).repartition(1).persist()
    assert model.forward_selection(d, ["busy", "level", "past"], "label", 2, 2, 1, 3, 2) == ["past", "level"]


def test_wide_sets_are_fitted_on_rows(spark, monkeypatch):
    d, used = planted(spark, 24).repartition(1).persist(), []
    monkeypatch.setattr(model, "CELL_FEATURES", 1)
    monkeypatch.setattr(model, "member", lambda *a, f=model.member, **k: used.append(a[1]) or f(*a, **k))
    assert model.forward_selection(d, ["busy", "past", "level"], "label", 2, 2, 1, 3, 2) == ["past", "level"]
    assert sorted(map(sorted, used)) == [["busy", "past"]] * 2 + [["level", "past"]] * 2


def test_areas_are_near_mllibs(spark):
    area = BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC")
    d = planted(spark, 60).repartition(1).withColumns({"label": F.col("label").cast("double"), "odd": F.when(F.col("past") > -1, F.round("busy") % 3), "gone": F.lit(None).cast("double")}).persist()
    train, test = d.where("symbol % 2 = 0").persist(), d.where("symbol % 2 = 1").persist()
    bins = model.binned(train, test, ["past", "level", "odd", "gone"], "label").persist()
    for use in (["past"], ["level", "past"], ["odd", "past"]):
        theirs = area.evaluate(model.member(train, use, "label", 1, 6, 3).transform(model.assembled(test, use)))
        assert model.cell_area(bins, use, 6, 3) == pytest.approx(theirs, abs=0.02) and theirs > 0.7
    # Nothing known of any row, and no row at all.
    assert model.cell_area(bins, ["gone"]) == model.cell_area(bins.where("false"), ["past"]) == 0.5


def test_cells_count_every_row_once(spark):
    d = planted(spark, 24).withColumns({"label": F.col("label").cast("double"), "few": F.col("symbol") % 5})
    bins = model.binned(d, d.limit(0), ["past", "few"], "label")
    got = model.cells(bins, ["few"]).toPandas()
    assert got["_n"].sum() == 24 * 30 and sorted(got["few"].unique()) == [0, 1, 2, 3, 4]
    sizes = model.cells(bins, ["past"]).groupBy("past").agg(F.sum("_n").alias("n")).toPandas()["n"]
    assert len(sizes) == model.BINS and sizes.min() >= 22 and sizes.max() <= 24


def test_a_tree_splits_where_the_variance_falls_most():
    r = np.random.default_rng(1)
    codes, y = np.array([np.arange(8).repeat(50), r.integers(0, 3, 400)]), np.arange(8).repeat(50) > 4
    f = model.boost(codes, y, np.full(400, 1000), 1, 1, 0.1, r)(codes)
    assert np.array_equal(f, np.where(y, 1.0, -1.0))
    assert model.area_of(f, y, np.ones(400)) == 1.0 and model.area_of(np.zeros(400), y, np.ones(400)) == 0.5
