"""The model queries do their whole job: all features, purged folds, the
operators' own rounds and shuffles."""

import datetime as dt
import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import model
from panelforge.plans import modelling


def planted(spark, days=40, names=30):
    """The class is past's sign, less often level's; the others are noise."""
    r = np.random.default_rng(4)
    rows = []
    for k in range(days):
        x = r.standard_normal((names, 4))
        y = x[:, 3] + 0.6 * x[:, 0] > 0
        rows += [(dt.date(2020, 1, 1) + dt.timedelta(days=k), i, *map(float, x[i]), int(y[i])) for i in range(names)]
    return spark.createDataFrame(rows, "ts date, symbol int, level double, busy double, spread double, past double, label int").withColumn("part", F.lit("train"))


def test_selection_tries_a_second_feature_on_purged_folds(spark):
    d = planted(spark, 24).repartition(1).persist()
    assert model.forward_selection(d, ["busy", "level", "past"], "label", 2, 2, 1, 3, 2) == ["past", "level"]


def test_the_selection_query_has_all_features(spark, monkeypatch):
    used = []
    monkeypatch.setattr(modelling, "panel", lambda s, sf: planted(spark))
    monkeypatch.setattr(modelling.g, "forward_selection", lambda *a, f=model.forward_selection, **k: used.append(inspect.signature(f).bind(*a, **k).arguments) or ["past"])
    modelling.g09_selection(spark, "")
    assert used[0]["features"] == modelling.FEATURES and used[0]["limit"] == 4 and not set(used[0]) & {"rounds", "depth"}


def test_importance_over_purged_folds(spark):
    d = planted(spark, 24).repartition(1).persist()
    got = model.cv_permutation_importance(d, modelling.FEATURES, "label", 2, 1, 1, 7, 3, 2)
    assert got[0][0] == "past" and got[0][1] > 0.05 and all(n == 2 for *_, n in got)


def test_queries_use_the_operators_rounds_and_shuffles(spark, monkeypatch):
    used = []
    monkeypatch.setattr(modelling.g, "member", lambda *a, f=model.member, **k: used.append(inspect.signature(f).bind(*a, **k).arguments))
    monkeypatch.setattr(modelling.g, "score", lambda models, df, features: df.withColumns({"prob_mean": F.lit(0.5), "prob_std": F.lit(0.0)}))
    monkeypatch.setattr(modelling.g, "permutation_importance", lambda *a, f=model.permutation_importance, **k: used.append(inspect.signature(f).bind(*a, **k).arguments) or [])
    monkeypatch.setattr(modelling.g, "cv_permutation_importance", lambda *a, **k: [], raising=False)
    monkeypatch.setattr(modelling, "panel", lambda s, sf: planted(spark).withColumns({"regime": F.lit("even"), "y": F.lit(0.0)}))
    modelling.g01_g05_members(spark, "")
    modelling.g08_g10_importance(spark, "")
    assert len(used) == 5 and not any(set(u) & {"rounds", "depth", "shuffles"} for u in used)


def test_saved_members_score_alike(spark, tmp_path):
    rows = [(i, float(i % 7), float(i % 3), float(i % 7 > 3)) for i in range(80)]
    d = spark.createDataFrame(rows, "symbol int, a double, b double, label double")
    m = [model.member(d, ["a", "b"], "label", s, rounds=2) for s in (1, 2)]
    model.save_members(m, str(tmp_path / "m"))
    back = model.load_members(str(tmp_path / "m"))
    one, two = (model.score(x, d, ["a", "b"]).orderBy("symbol").select("prob_mean", "prob_std").collect() for x in (m, back))
    assert len(back) == 2 and one == two
    with pytest.raises(ValueError):
        model.save_members([], str(tmp_path / "n"))
