"""Models of the panel with MLlib: members, calibration, routing, importance.
Fitting is MLlib's; what is computed here around it stays in DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.functions.exprs import corr
from panelforge.operators import windows as w
from panelforge.operators.labels import purged_folds

C = F.col

#: Independent fits and evaluations that the driver has running at once: each is
#: a chain of short jobs that leaves most of a cluster idle by itself.
AT_ONCE = 8
#: Rows that one task of shuffled() orders, about.
SHUFFLE_ROWS = 250_000


def at_once(f: Callable, items: Iterable) -> list:
    """f of every item, in order; the driver only waits, jobs run side by side."""
    todo = list(items)
    if len(todo) < 2:
        return [f(x) for x in todo]
    with ThreadPool(min(AT_ONCE, len(todo))) as pool:
        return pool.map(inheritable_thread_target(f), todo, chunksize=1)


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    """A features vector; rows with a missing feature are left out (impute
    first)."""
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df)


def has_two_classes(df: DataFrame, label: str) -> bool:
    """A fold with one class can't be fitted and is skipped by callers."""
    return df.where(C(label).isNotNull()).select(label).distinct().limit(2).count() == 2


def member(train: DataFrame, features: list[str], label: str, seed: int, rounds: int = 20, depth: int = 3, shrink: float = 0.1):
    """One boosted classifier, or None if there is one class only."""
    if not has_two_classes(train, label):
        return None
    return GBTClassifier(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=shrink, subsamplingRate=0.8, seed=seed).fit(
        assembled(train.where(C(label).isNotNull()).withColumn(label, C(label).cast("double")), features))


def rank_member(train: DataFrame, features: list[str], target: str, seed: int, rounds: int = 20, depth: int = 3):
    """One boosted regressor on a rank target."""
    return GBTRegressor(featuresCol="features", labelCol=target, maxIter=rounds, maxDepth=depth, subsamplingRate=0.8, seed=seed).fit(assembled(train.where(C(target).isNotNull()), features))


def score(models: list, df: DataFrame, features: list[str]) -> DataFrame:
    """Adds prob_mean and prob_std over the members' probabilities."""
    d = assembled(df, features)
    names = []
    for i, m in enumerate(models):
        keep = d.columns
        d = m.transform(d).withColumn(f"_p{i}", vector_to_array("probability")[1]).select(*keep, f"_p{i}")
        names.append(f"_p{i}")
    mean = sum((C(n) for n in names[1:]), C(names[0])) / len(names)
    d = d.withColumn("prob_mean", mean)
    var = sum(((C(n) - C("prob_mean")) ** 2 for n in names[1:]), (C(names[0]) - C("prob_mean")) ** 2) / len(names)
    return d.withColumn("prob_std", F.sqrt(var)).drop("features", *names)


def save_members(members: list, path: str) -> None:
    """Fitted models, in their order, in one folder that every executor's store
    can hold. No member is an error: there is nothing to load later."""
    if not members:
        raise ValueError("no fitted member to save")
    PipelineModel(stages=members).write().overwrite().save(path)


def load_members(path: str) -> list:
    return PipelineModel.load(path).stages


def calibrate(df: DataFrame, prob: str, label: str):
    """('isotonic' or 'sigmoid', model): whichever has the lower Brier score."""
    d = df.where(C(label).isNotNull()).select(C(prob).alias("p"), C(label).cast("double").alias("label"))
    iso = IsotonicRegression(featuresCol="p", labelCol="label").fit(d)
    v = VectorAssembler(inputCols=["p"], outputCol="features").transform(d)
    sig = LogisticRegression(featuresCol="features", labelCol="label").fit(v)
    one = iso.transform(d).agg(F.avg((C("prediction") - C("label")) ** 2)).first()[0]
    two = sig.transform(v).agg(F.avg((vector_to_array("probability")[1] - C("label")) ** 2)).first()[0]
    return ("isotonic", iso) if one <= two else ("sigmoid", sig)


def expected_value(df: DataFrame, prob: str, ret: str):
    """An isotonic map from probability to expected return."""
    return IsotonicRegression(featuresCol=prob, labelCol=ret).fit(df.where(C(ret).isNotNull()).select(prob, ret))


def routed(pooled: DataFrame, by_regime: dict[str, DataFrame], keys: list[str], prob: str = "prob_mean") -> DataFrame:
    """The regime's own score where there is a model for it, else the pooled."""
    d = pooled.withColumn("routed", C(prob))
    for name, part in by_regime.items():
        p = part.where(C("regime") == name).select(*keys, C(prob).alias("_r"))
        d = d.join(p, keys, "left").withColumn("routed", F.coalesce("_r", "routed")).drop("_r")
    return d


def quality(df: DataFrame, prob: str, label: str, ret: str, *keys: str) -> DataFrame:
    """keys, n, brier, ic (rank correlation with the return)."""
    d = df.where(C(label).isNotNull() & C(ret).isNotNull() & C(prob).isNotNull())
    d = d.withColumns({"_a": w.xs_rank(C(prob), *(keys or (F.lit(1),)), pct=False), "_b": w.xs_rank(C(ret), *(keys or (F.lit(1),)), pct=False)})
    return d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((C(prob) - C(label)) ** 2).alias("brier"), corr(C("_a"), C("_b")).alias("ic"))


def shuffled(df: DataFrame, column: str, seed: int, parts: int = 64) -> DataFrame:
    """df with one column's values dealt out anew: rows are numbered in a fixed
    and in a random order within parts of a hash, and met by number, so no task
    orders the whole table. The caller raises parts with the rows."""
    part = F.pmod(F.xxhash64(*df.columns), F.lit(parts))
    d = df.withColumn("_b", part)
    o = Window.partitionBy("_b")
    a = d.withColumn("_i", F.row_number().over(o.orderBy(*df.columns))).drop(column)
    b = d.select("_b", C(column), F.row_number().over(o.orderBy(F.xxhash64(*[C(c) for c in df.columns], F.lit(seed)))).alias("_i"))
    return a.join(b, ["_b", "_i"]).drop("_b", "_i").select(*df.columns)


def permutation_importance(model, df: DataFrame, features: list[str], label: str, shuffles: int = 2, seed: int = 7) -> list[tuple[str, float]]:
    """(feature, mean fall of the area under the curve), greatest first.
    Features the model doesn't use are 0 without scoring."""
    area = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC")
    d = df.where(C(label).isNotNull()).withColumn(label, C(label).cast("double"))
    parts = max(64, d.count() // SHUFFLE_ROWS)
    used = [features[i] for i in model.featureImportances.indices]
    runs = [(f, k) for f in used for k in range(shuffles)]
    scored = lambda x: area.evaluate(model.transform(assembled(x, features)))
    base, *areas = at_once(lambda x: scored(shuffled(d, x[0], seed + x[1], parts) if x else d), [None, *runs])
    falls = {f: [base - a for (g, _), a in zip(runs, areas, strict=True) if g == f] or [0.0] for f in features}
    return sorted([(f, sum(x) / len(x)) for f, x in falls.items()], key=lambda x: -x[1])


#: Fixed values of recommend(): fall of the area that is useful, that hurts and
#: that is exceptional in one regime; rank correlation that is weak.
USEFUL, HURTS, EXCEPTIONAL, WEAK_IC = 0.0010, -0.0005, 0.0030, 0.02


def recommend(overall: Column, by_regime: Column, regime_ics: Column, mean_abs_ic: Column) -> Column:
    """DROP_HARMFUL, KEEP, DROP or REVIEW by the fall of the area over all rows,
    the falls and rank correlations within regimes (arrays, NULL where unknown)
    and the mean |IC|. Harm in any regime goes first; one sign of worth keeps a
    feature; only one that is weak everywhere is dropped."""
    falls = F.filter(by_regime, lambda x: x.isNotNull())
    ics = F.filter(regime_ics, lambda x: x.isNotNull())
    fall, ic = F.coalesce(overall, F.lit(0.0)), F.coalesce(mean_abs_ic, F.lit(0.0))
    keep = (F.exists(falls, lambda x: x >= EXCEPTIONAL) | F.exists(ics, lambda x: F.abs(x) >= 2 * WEAK_IC) | (fall >= 3 * USEFUL) | (ic >= 2 * WEAK_IC))
    dead = (F.size(falls) > 0) & F.forall(falls, lambda x: x < USEFUL) & (fall < USEFUL) & (ic < WEAK_IC)
    return F.when(F.exists(falls, lambda x: x < HURTS), "DROP_HARMFUL").when(keep, "KEEP").when(dead, "DROP").otherwise("REVIEW")


def in_folds(df: DataFrame, label: str, folds: int = 3, embargo: int = 5) -> list[tuple[DataFrame, DataFrame]]:
    """(train, test) of each purged fold whose two sides have both classes."""
    d = df.where(C(label).isNotNull()).withColumn(label, C(label).cast("double"))
    d = d.join(F.broadcast(purged_folds(df, folds, embargo).select("ts", "fold", C("part").alias("_part"))), "ts")
    pairs = [tuple(d.where((C("fold") == k) & (C("_part") == p)).drop("fold", "_part") for p in ("train", "test")) for k in range(folds)]
    both = at_once(lambda x: has_two_classes(x, label), [y for x in pairs for y in x])
    return [x for x, a, b in zip(pairs, both[::2], both[1::2], strict=True) if a and b]


def cv_permutation_importance(df: DataFrame, features: list[str], label: str, folds: int = 3, embargo: int = 5, shuffles: int = 2, seed: int = 7, rounds: int = 20, depth: int = 3) -> list[tuple[str, float, float, int]]:
    """(feature, mean and deviation of its fall over purged folds, folds used),
    greatest first; each fold has a member of its own."""
    pairs = in_folds(df, label, folds, embargo)
    models = at_once(lambda x: member(x[0], features, label, 1, rounds, depth), pairs)
    falls: dict[str, list[float]] = {f: [] for f in features}
    for k, (m, (_, test)) in enumerate(zip(models, pairs, strict=True)):
        for f, x in permutation_importance(m, test, features, label, shuffles, seed + 100 * k):
            falls[f].append(x)
    return sorted([(f, float(np.mean(x)), float(np.std(x)), len(x)) for f, x in falls.items() if x], key=lambda x: -x[1])


#: Bins of a feature and greatest number of features of a cells() table, which
#: then has 2 * BINS ** CELL_FEATURES rows a side at most, however many it counts.
BINS, CELL_FEATURES = 32, 4


def _real(f: str) -> Column:
    x = C(f).cast("double")
    return F.when(~F.isnan(x), x)


def bin_edges(df: DataFrame, features: list[str]) -> list[list[float]]:
    """Upper ends of all bins but the last by feature: every value where there
    are BINS at most, else quantiles of all rows."""
    few = at_once(lambda f: df.select(_real(f).alias("x")).where("x is not null").distinct().limit(BINS + 1).toPandas()["x"], features)
    points = [k / BINS for k in range(1, BINS)]
    cuts = df.agg(*[F.percentile_approx(_real(f), points, 10_000).alias(f"c{i}") for i, f in enumerate(features)]).first()
    return [sorted(map(float, set(cuts[i] or [])) if len(x) > BINS else map(float, sorted(x)[:-1])) for i, x in enumerate(few)]


def binned(train: DataFrame, test: DataFrame, features: list[str], label: str) -> DataFrame:
    """Both sides' rows as bin numbers of the training side's bins (NULL where a
    value is missing), with the class and the side."""
    edges = bin_edges(train, features)
    at = {f: F.when(_real(f).isNotNull(), sum((F.when(_real(f) > F.lit(e), 1).otherwise(0) for e in es), F.lit(0))).cast("tinyint") for f, es in zip(features, edges, strict=True)}
    sides = [d.select(*[c.alias(f) for f, c in at.items()], (C(label) > 0).alias("_y"), F.lit(k).alias("_train")) for d, k in ((train, True), (test, False))]
    return sides[0].unionByName(sides[1])


def cells(df: DataFrame, use: list[str]) -> DataFrame:
    """Rows of binned() counted by what a tree over these features can tell
    apart; rows with a missing one are left out."""
    return df.dropna(subset=use).groupBy(*use, "_y", "_train").agg(F.count("*").alias("_n"))


def boost(codes: np.ndarray, y: np.ndarray, n: np.ndarray, rounds: int, depth: int, shrink: float, rng: np.random.Generator) -> Callable:
    """Boosted trees over bin numbers (a row of codes a feature) of n equal rows
    each with class y, as GBTClassifier fits them: the first tree has full
    weight, the others shrink; each sees a share of 0.8 of all rows, drawn one
    by one. Returns the score of other codes."""
    side = np.where(y, 1.0, -1.0)
    f = np.zeros(len(y))
    trees = []

    def walk(tree: list, codes: np.ndarray) -> np.ndarray:
        node = np.zeros(codes.shape[1], dtype=np.int64)
        for of, cut, _ in tree[:-1]:
            k = of[node]
            right = (k >= 0) & (codes[np.maximum(k, 0), np.arange(codes.shape[1])] > cut[node])
            node = 2 * node + right
        return tree[-1][2][node]

    for t in range(rounds):
        r = side if t == 0 else 4 * side / (1 + np.exp(2 * side * f))
        w = rng.binomial(n, 0.8).astype(float)
        node, tree, open_ = np.zeros(len(y), dtype=np.int64), [], np.array([True])
        value = np.array([(w * r).sum() / max(w.sum(), 1.0)])
        for _ in range(depth):
            size = len(open_)
            best, of, cut = np.zeros(size), np.full(size, -1), np.zeros(size, dtype=np.int64)
            kids = np.repeat(value, 2)
            for k, c in enumerate(codes):
                place = node * BINS + c
                a, b = (np.bincount(place, x, size * BINS).reshape(size, BINS).cumsum(1) for x in (w, w * r))
                na, sa, nb, sb = a, b, a[:, -1:] - a, b[:, -1:] - b
                ok = (na > 0.5) & (nb > 0.5) & open_[:, None]
                m = np.maximum
                gain = np.where(ok, sa * sa / m(na, 1) + sb * sb / m(nb, 1) - (b[:, -1:] ** 2) / m(a[:, -1:], 1), 0.0)
                j = gain.argmax(1)
                i = np.arange(size)
                won = gain[i, j] > best + 1e-9
                best, of, cut = np.where(won, gain[i, j], best), np.where(won, k, of), np.where(won, j, cut)
                kids[0::2] = np.where(won, sa[i, j] / m(na[i, j], 1), kids[0::2])
                kids[1::2] = np.where(won, sb[i, j] / m(nb[i, j], 1), kids[1::2])
            tree.append((of, cut, value))
            k = of[node]
            node = 2 * node + ((k >= 0) & (codes[np.maximum(k, 0), np.arange(len(y))] > cut[node]))
            # A node that isn't split goes on as its left child, closed.
            value, open_ = kids, np.repeat(of >= 0, 2)
        tree.append((None, None, value))
        trees.append(tree)
        f = f + (1.0 if t == 0 else shrink) * value[node]
    return lambda codes: sum(((1.0 if t == 0 else shrink) * walk(x, codes) for t, x in enumerate(trees)), np.zeros(codes.shape[1]))


def area_of(f: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Area under the curve of scores that n rows of class y have each."""
    _, at = np.unique(f, return_inverse=True)
    up, down = (np.bincount(at, np.where(y == k, n, 0)) for k in (True, False))
    if not up.sum() or not down.sum():
        return 0.5
    return float((up * (down.cumsum() - down / 2)).sum() / (up.sum() * down.sum()))


def cell_area(df: DataFrame, use: list[str], rounds: int = 20, depth: int = 3, shrink: float = 0.1, seed: int = 1) -> float:
    """Test area of one boosted classifier fitted on the training side's cells().
    Rows are counted where they lie; only the cells meet, in one task."""
    def fit(batches):
        got = list(batches)
        if not got:
            return
        t = pa.Table.from_batches(got)
        x = np.array([t[c].to_numpy() for c in [*use, "_y", "_train", "_n"]], dtype=np.int64).reshape(len(use) + 3, -1)
        x = x[:, np.lexsort(x)]
        codes, y, train, n = x[:len(use)], x[-3] > 0, x[-2] > 0, x[-1]
        known = len(np.unique(y[train])) == 2
        area = area_of(boost(codes[:, train], y[train], n[train], rounds, depth, shrink, np.random.default_rng(seed))(codes[:, ~train]), y[~train], n[~train]) if known else 0.5
        yield pa.RecordBatch.from_pydict({"area": [area]})

    found = cells(df, use).repartition(1).mapInArrow(fit, "area double").collect()
    return found[0]["area"] if found else 0.5


def forward_selection(df: DataFrame, features: list[str], label: str, limit: int, folds: int = 3, embargo: int = 5, rounds: int = 20, depth: int = 3) -> list[str]:
    """Features added one by one while they raise the mean test area of the
    purged folds by 0.001. Trees tell rows apart by their bins only, so they are
    fitted on counts of equal rows; sets of more than CELL_FEATURES features,
    which have too many cells, on the rows themselves."""
    area = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC")
    pairs = in_folds(df, label, folds, embargo)
    small = at_once(lambda x: binned(*x, features, label).persist(), pairs)
    chosen: list[str] = []
    best = 0.5

    def held_out(x):
        use, (train, test), bins = x
        if len(use) <= CELL_FEATURES:
            return cell_area(bins, use, rounds, depth)
        return area.evaluate(member(train, use, label, 1, rounds, depth).transform(assembled(test, use)))

    while len(chosen) < limit and pairs:
        left = [f for f in features if f not in chosen]
        areas = at_once(held_out, [([*chosen, f], x, b) for f in left for x, b in zip(pairs, small, strict=True)])
        tried = [(sum(areas[i * len(pairs):(i + 1) * len(pairs)]) / len(pairs), f) for i, f in enumerate(left)]
        if not tried or max(tried)[0] < best + 0.001:
            break
        best, f = max(tried)
        chosen.append(f)
    for x in small:
        x.unpersist()
    return chosen


def interpolate(x, points: list[tuple[float, float]]):
    """Piecewise linear through the points, level beyond them, as a column."""
    p = sorted(points)
    out = F.lit(p[-1][1])
    for (a, u), (b, v) in reversed(list(zip(p, p[1:], strict=False))):
        out = F.when(x <= b, u + (x - a) * ((v - u) / (b - a) if b > a else 0.0)).otherwise(out)
    return F.when(x.isNotNull(), F.when(x <= p[0][0], F.lit(p[0][1])).otherwise(out))


def watchlist(scored: DataFrame, table: list[tuple[float, float]], agree: float, k: int) -> DataFrame:
    """The last row of each symbol whose members agree, by probability and
    expected return."""
    last = F.row_number().over(Window.partitionBy("symbol").orderBy(C("ts").desc()))
    d = scored.withColumn("_k", last).where((C("_k") == 1) & (C("prob_std") <= agree)).drop("_k")
    return d.withColumn("expected", interpolate(C("prob_mean"), table)).orderBy(C("prob_mean").desc(), C("expected").desc(), "symbol").limit(k)
