"""Scores of signals against forward returns, in long form: one row per
feature, date and symbol, so all features are one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.functions.exprs import corr, div
from panelforge.operators import aggregates as agg
from panelforge.operators import windows as w

C = F.col


def long_form(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """feature, x and the kept columns."""
    return df.unpivot(keep, features, "feature", "x")


def daily_ic(long: DataFrame, y: str, least: int) -> DataFrame:
    """feature, ts, names, ic: rank correlation of x and y in a date's
    cross-section of pairs that are both known, NULL for thin dates."""
    d = long.where(C("x").isNotNull() & C(y).isNotNull())
    d = d.withColumns({"_a": w.xs_rank(C("x"), "feature", "ts", pct=False), "_b": w.xs_rank(C(y), "feature", "ts", pct=False)})
    d = d.groupBy("feature", "ts").agg(F.count("*").alias("names"), corr(C("_a"), C("_b")).alias("ic"))
    return d.withColumn("ic", F.when(C("names") >= least, C("ic")))


def newey_west(series: DataFrame, x: str, lag: int, *keys: str, order: str = "ts") -> DataFrame:
    """keys, n, mean, t: mean over its autocorrelation-robust error (Bartlett
    weights, population covariances)."""
    d = series.where(C(x).isNotNull())
    p = Window.partitionBy(*keys)
    d = d.withColumn("_e", C(x) - F.avg(x).over(p))
    terms = {f"_g{k}": C("_e") * F.lag("_e", k).over(p.orderBy(order)) for k in range(1, lag + 1)}
    d = d.withColumns(terms)
    n = F.count("*")
    var = F.sum(C("_e") * C("_e")) / n
    for k in range(1, lag + 1):
        var = var + 2 * (1 - k / (lag + 1)) * F.coalesce(F.sum(f"_g{k}"), F.lit(0.0)) / n
    out = d.groupBy(*keys).agg(n.alias("n"), F.avg(x).alias("mean"), var.alias("_v"))
    return out.withColumn("t", F.when(C("_v") > 0, C("mean") / F.sqrt(C("_v") / C("n")))).drop("_v")


def summary(ic: DataFrame) -> DataFrame:
    """feature, n, mean, std, positive share and plain t of its daily ICs."""
    d = ic.where("ic is not null").groupBy("feature").agg(F.count("*").alias("n"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("std"), F.avg((C("ic") > 0).cast("double")).alias("positive"))
    return d.withColumn("t", div(C("mean"), C("std") / F.sqrt("n")))


def pooled(long: DataFrame, y: str) -> DataFrame:
    """feature, ic: rank correlation over all rows at once. A feature's ranks
    need its rows in one order, so this is for reports, not for hot loops."""
    d = long.where(C("x").isNotNull() & C(y).isNotNull())
    d = d.withColumns({"_a": w.xs_rank(C("x"), "feature", pct=False), "_b": w.xs_rank(C(y), "feature", pct=False)})
    return d.groupBy("feature").agg(corr(C("_a"), C("_b")).alias("ic"))


def fold_signs(ic: DataFrame, folds: int, skip: int) -> DataFrame:
    """feature, agree: share of time folds whose mean IC has the sign of the
    whole; the first `skip` rows of every later fold are left out. Folds are as
    even as can be, the longer ones first."""
    d = ic.where("ic is not null")
    p = Window.partitionBy("feature")
    d = d.withColumns({"_k": F.row_number().over(p.orderBy("ts")) - 1, "_n": F.count("*").over(p), "_m": F.avg("ic").over(p)})
    size, more = F.floor(C("_n") / folds), C("_n") % folds
    big = more * (size + 1)
    d = d.withColumn("_f", F.when(C("_k") < big, F.floor(C("_k") / (size + 1))).otherwise(more + F.floor((C("_k") - big) / F.greatest(size, F.lit(1)))))
    first = F.row_number().over(Window.partitionBy("feature", "_f").orderBy("ts"))
    d = d.withColumn("_i", first).where((C("_f") == 0) | (C("_i") > skip))
    m = d.groupBy("feature", "_f").agg(F.avg("ic").alias("_c"), F.first("_m").alias("_m"))
    return m.groupBy("feature").agg(F.avg((F.signum("_c") == F.signum("_m")).cast("double")).alias("agree"))


def long_short(df: DataFrame, x: str, y: str, step: int, q: int, least: int, cost: float = 0.0) -> DataFrame:
    """ts, names, gross, turnover, net, equity, drawdown of a portfolio that is
    long the top and short the bottom bucket, renewed every `step` dates. Thin
    dates don't trade, so turnover is against the last date that did."""
    d = df.where(C(x).isNotNull() & C(y).isNotNull())
    dates = d.groupBy("ts").agg(F.count("*").alias("names")).where(C("names") >= least)
    o = Window.partitionBy(F.lit("dates")).orderBy("ts")
    dates = dates.withColumn("_k", F.row_number().over(o) - 1).where(C("_k") % step == 0).select("ts", "names")
    d = d.join(F.broadcast(dates), "ts").withColumn("_b", agg.rank_bucket(C(x), q, "ts", ties=("symbol",)))
    legs = d.groupBy("ts", "names").agg(F.avg(F.when(C("_b") == q, C(y))).alias("_l"), F.avg(F.when(C("_b") == 1, C(y))).alias("_s"),
                                       F.collect_set(F.when(C("_b") == q, C("symbol"))).alias("_up"), F.collect_set(F.when(C("_b") == 1, C("symbol"))).alias("_down"))
    new = lambda c: 1 - F.size(F.array_intersect(c, F.lag(c).over(o))) / F.size(c)
    legs = legs.withColumns({"gross": C("_l") - C("_s"), "turnover": F.coalesce((new(C("_up")) + new(C("_down"))) / 2, F.lit(1.0))})
    legs = legs.withColumn("net", C("gross") - C("turnover") * cost)
    run = o.rowsBetween(Window.unboundedPreceding, 0)
    legs = legs.withColumn("equity", F.exp(F.sum(F.log(F.greatest(1 + C("net"), F.lit(1e-9)))).over(run)))
    return legs.withColumn("drawdown", C("equity") / F.greatest(F.max("equity").over(run), F.lit(1.0)) - 1).drop("_l", "_s", "_up", "_down")


def profile(df: DataFrame, x: str, y: str, q: int) -> DataFrame:
    """bucket, n, mean: mean outcome by daily rank bucket."""
    d = df.where(C(x).isNotNull() & C(y).isNotNull()).withColumn("bucket", agg.rank_bucket(C(x), q, "ts", ties=("symbol",)))
    return d.groupBy("bucket").agg(F.count("*").alias("n"), F.avg(y).alias("mean"))


def by_group(long: DataFrame, y: str, group: str, least: int) -> DataFrame:
    """feature, group, dates, mean: ICs in all rows ('ALL') and within each
    group."""
    d = long.withColumn("_g", F.explode(F.array(F.lit("ALL"), C(group))))
    ic = daily_ic(d.withColumn("feature", F.concat_ws("|", "feature", "_g")), y, least).where("ic is not null")
    s = F.split("feature", r"\|")
    return ic.groupBy(s[0].alias("feature"), s[1].alias("group")).agg(F.count("*").alias("dates"), F.avg("ic").alias("mean"))


def trailing(df: DataFrame, horizons=(5, 20, 60)) -> DataFrame:
    return df.withColumns({f"past{n}": div(C("close"), w.delay(C("close"), n)) - 1 for n in horizons})


def generate(df: DataFrame, features: list[str], gate: Column) -> DataFrame:
    """strategy, ts, symbol, x: features alone, products and sign agreements of
    every two, features gated by a flag, and the mean of all; as daily z-scores
    so that they can be combined."""
    z = df.withColumns({f: w.xs_zscore(C(f), "ts") for f in features})
    cols = {f"single:{f}": C(f) for f in features}
    for i, a in enumerate(features):
        for b in features[i + 1:]:
            cols[f"product:{a}*{b}"] = C(a) * C(b)
            cols[f"agree:{a}&{b}"] = F.when(F.signum(a) == F.signum(b), C(a) + C(b)).otherwise(0.0)
    cols |= {f"gate:{f}": F.when(gate, C(f)) for f in features}
    total = C(features[0])
    for f in features[1:]:
        total = total + C(f)
    cols["mean:all"] = total / len(features)
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("strategy"), v.cast("double").alias("x")) for k, v in cols.items()]))
    return z.withColumn("_r", rows).select("_r.strategy", "ts", "symbol", "_r.x")


#: Fixed values of the two sets of rules.
STABLE, STRONG, PROMISING, YEARS, LEAK_IR, LEAK_SHARPE = 0.6, (0.90, 1.0), (0.50, 0.40), 0.60, 0.50, 6.0


def feature_verdict(t: Column, floor: float | Column, net_sharpe: Column, stable: Column, test_ic: Column, mean_ic: Column) -> Column:
    """What a single feature's scan says: the first rule that fails. Unknown
    Sharpe, stability or test IC fail nothing."""
    turns = F.signum(test_ic) != F.signum(mean_ic)
    return (F.when(t.isNull(), "insufficient_data").when(F.abs(t) < floor, "noise (fails multiple-testing)").when(net_sharpe <= 0, "fails net-of-cost")
            .when(stable < STABLE, "unstable across folds").when(turns, "decays out-of-sample").otherwise("CANDIDATE"))


def strategy_verdict(t: Column, floor: float | Column, ir: Column, gross_sharpe: Column, net_sharpe: Column, dsr: Column, year_hit: Column, test_ic: Column, mean_ic: Column) -> Column:
    """What a strategy's score says: too good is a leak, under the floor no
    edge; strong and promising need the deflated ratio, the net Sharpe, good
    years and a test IC that doesn't turn."""
    lasting = (F.coalesce(year_hit, F.lit(0.0)) >= YEARS) & F.coalesce(F.signum(test_ic) == F.signum(mean_ic), test_ic.isNull())
    passes = lambda lim: (F.coalesce(dsr, F.lit(0.0)) >= lim[0]) & F.coalesce(net_sharpe >= lim[1], F.lit(False)) & lasting
    return (F.when((F.abs(ir) > LEAK_IR) | F.coalesce(gross_sharpe > LEAK_SHARPE, F.lit(False)), "AVOID (too good - check leakage)")
            .when(F.coalesce(F.abs(t), F.lit(0.0)) < floor, "NO_EDGE").when(passes(STRONG), "STRONG").when(passes(PROMISING), "PROMISING").otherwise("MARGINAL"))


def day_states(df: DataFrame, wide: int = 20, least: int = 5) -> DataFrame:
    """ts, vol_state, trend_state, dispersion_state of the market, each HIGH/LOW
    or UP/DOWN against its own mean over the dates before, as known the date
    before; UNKNOWN at the start."""
    d = df.withColumn("_r", w.pct_change(C("close"))).groupBy("ts").agg(F.avg("_r").alias("_m"), F.stddev_samp("_r").alias("_s"))
    o = Window.partitionBy(F.lit("dates")).orderBy("ts")
    past = o.rowsBetween(-wide, -1)
    d = d.withColumns({"_v": F.when(F.count("_m").over(past) >= least, F.stddev_samp("_m").over(past)), "_t": F.when(F.count("_m").over(past) >= least, F.avg("_m").over(past)), "_d": F.lag("_s").over(o)})
    far = o.rowsBetween(Window.unboundedPreceding, -1)
    state = lambda x, base, up, down: F.when(x > base, up).when(x <= base, down).otherwise("UNKNOWN")
    return d.select("ts", state(C("_v"), F.avg("_v").over(far), "HIGH", "LOW").alias("vol_state"), state(C("_t"), F.lit(0.0), "UP", "DOWN").alias("trend_state"),
                    state(C("_d"), F.avg("_d").over(far), "HIGH", "LOW").alias("dispersion_state"))


def screen(scores: DataFrame, ic: float, positive: float, t: float) -> DataFrame:
    """Features whose mean IC, share of good days and t are all far from chance;
    the share counts for the sign of the mean."""
    right = F.when(C("mean") >= 0, C("positive")).otherwise(1 - C("positive"))
    return scores.where((F.abs("mean") >= ic) & (right >= positive) & (F.abs("t") >= t))


def by_period(ic: DataFrame, period: Column) -> DataFrame:
    """feature, periods, mean, worst, flips: mean ICs of the periods, and the
    share of periods whose sign differs from the mean's."""
    d = ic.where("ic is not null").groupBy("feature", period.alias("_p")).agg(F.avg("ic").alias("_m"))
    d = d.withColumn("_a", F.avg("_m").over(Window.partitionBy("feature")))
    return d.groupBy("feature").agg(F.count("*").alias("periods"), F.avg("_m").alias("mean"), F.min(C("_m") * F.signum("_a")).alias("worst"), F.avg((F.signum("_m") != F.signum("_a")).cast("double")).alias("flips"))


def near_pairs(df: DataFrame, features: list[str], least: float) -> list[tuple[str, str, float]]:
    """Pairs of features with |correlation| of `least` or more: one aggregate
    over the rows, one number a pair."""
    named = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
    row = df.agg(*[corr(C(a), C(b)).alias(f"{a}|{b}") for a, b in named]).first()
    return [(a, b, row[f"{a}|{b}"]) for a, b in named if row[f"{a}|{b}"] is not None and abs(row[f"{a}|{b}"]) >= least]


def deflated(scores: DataFrame, n_trials: int) -> DataFrame:
    """Adds benchmark (the Sharpe ratio that the best of n_trials without effect
    is expected to show: their robust spread times the expected maximum) and
    deflated, the probability that the true ratio is over it. scores: feature,
    n, sr, skew, kurt."""
    from panelforge.functions.stats import expected_max_t, probabilistic_sharpe

    med = scores.agg(F.percentile("sr", 0.5).alias("_med"))
    d = scores.crossJoin(F.broadcast(med))
    mad = d.agg((F.percentile(F.abs(C("sr") - C("_med")), 0.5) * 1.4826).alias("_mad"))
    d = d.crossJoin(F.broadcast(mad))
    spread = F.sqrt(F.greatest(C("_mad") * C("_mad"), 1 / C("n")))
    d = d.withColumn("benchmark", spread * expected_max_t(n_trials))
    return d.withColumn("deflated", probabilistic_sharpe(C("sr"), C("benchmark"), C("n"), C("skew"), C("kurt"))).drop("_med", "_mad")


def character(pairs: DataFrame, momentum: float = 0.02) -> DataFrame:
    """Adds what a score's correlation with past returns says of it."""
    m = C("mean")
    return pairs.withColumn("character", F.when(m > momentum, "momentum").when(m < -momentum, "reversion").otherwise("neutral"))


def clusters(pairs: list[tuple[str, str, float]], limit: float) -> list[list[str]]:
    """Single-linkage clusters of features by |correlation|: a short list."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b, r in pairs:
        a, b = find(a), find(b)
        if abs(r) >= limit and a != b:
            root[max(a, b)] = min(a, b)
    out: dict[str, list[str]] = {}
    for x in sorted(root):
        out.setdefault(find(x), []).append(x)
    return [v for v in out.values() if len(v) > 1]


def without_redundant(order: list[str], near: dict[tuple[str, str], float], limit: float = 0.92) -> list[str]:
    """Greedy: features in order of merit, less those too close to a kept one."""
    kept: list[str] = []
    for f in order:
        if all(abs(near.get((f, k), near.get((k, f), 0.0))) < limit for k in kept):
            kept.append(f)
    return kept


def walk_forward(ic: DataFrame, window: int, step: int) -> DataFrame:
    """feature, windows, positive: share of sliding windows of dates whose mean
    IC is above 0. A row goes to the few windows it lies in."""
    d = ic.where("ic is not null").withColumn("_k", F.row_number().over(Window.partitionBy("feature").orderBy("ts")) - 1)
    d = d.withColumn("_n", F.count("*").over(Window.partitionBy("feature")))
    first = F.greatest(F.ceil((C("_k") - window + 1) / step), F.lit(0)).cast("int")
    d = d.withColumn("_w", F.explode(F.when(first <= F.floor(C("_k") / step).cast("int"), F.sequence(first, F.floor(C("_k") / step).cast("int"))))).where(C("_w") * step + window <= C("_n"))
    m = d.groupBy("feature", "_w").agg(F.avg("ic").alias("m"))
    return m.groupBy("feature").agg(F.count("*").alias("windows"), F.avg((C("m") > 0).cast("double")).alias("positive"))
