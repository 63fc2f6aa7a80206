"""Trades on bars: barriers on the path ahead, and a portfolio of few slots."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.functions.exprs import div
from panelforge.operators import windows as w

C = F.col


def paths(df: DataFrame, n: int) -> DataFrame:
    """entry (next open) and the ratios of the next n highs, lows and closes to
    it, as arrays; rows without a whole path are left out."""
    d = df.withColumn("entry", w.lead(C("open"), 1))
    ahead = lambda c: F.array(*[div(w.lead(C(c), k), C("entry")) for k in range(1, n + 1)])
    d = d.withColumns({"hr": ahead("high"), "lr": ahead("low"), "cr": ahead("close"), "ahead": F.array(*[w.lead(C("ts"), k) for k in range(1, n + 1)])})
    return d.where(F.forall("cr", lambda x: x.isNotNull()) & F.forall("hr", lambda x: x.isNotNull()) & F.forall("lr", lambda x: x.isNotNull()))


def barrier(df: DataFrame, tp: Column, sl: Column, n: int) -> DataFrame:
    """Adds outcome (TP, SL, TIME), exit_bar, ret, mfe and mae, in per cent: the
    first bar that touches a barrier ends a trade, the stop first if both do in
    one bar. Expressions over the path arrays, no rows are made."""
    touch = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.when(F.get("lr", k) <= 1 - sl / 100, 2).when(F.get("hr", k) >= 1 + tp / 100, 1).otherwise(0))
    d = df.withColumn("_t", touch)
    hit = F.coalesce(F.array_min(F.transform(F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.get("_t", k) > 0), lambda k: k)), F.lit(n - 1))
    d = d.withColumn("_k", hit).withColumn("_o", F.get("_t", "_k"))
    d = d.withColumns({"outcome": F.when(C("_o") == 2, "SL").when(C("_o") == 1, "TP").otherwise("TIME"), "exit_bar": (C("_k") + 1).cast("int"),
                       "ret": F.when(C("_o") == 2, -sl).when(C("_o") == 1, tp).otherwise((F.get("cr", "_k") - 1) * 100),
                       "mfe": (F.array_max(F.slice("hr", 1, C("_k") + 1)) - 1) * 100, "mae": (F.array_min(F.slice("lr", 1, C("_k") + 1)) - 1) * 100,
                       "exit_ts": F.get("ahead", "_k")})
    return d.drop("_t", "_k", "_o")


def _outcomes() -> list[Column]:
    rate = lambda k: F.avg((C("outcome") == k).cast("double"))
    return [F.count("*").alias("n"), rate("TP").alias("tp_rate"), rate("SL").alias("sl_rate"), rate("TIME").alias("time_rate"), F.avg((C("ret") > 0).cast("double")).alias("win_rate"),
            F.avg("ret").alias("expectancy"), F.avg("mfe").alias("mean_mfe"), F.avg("mae").alias("mean_mae"), F.avg("exit_bar").alias("hold")]


def summary(df: DataFrame, *keys: str) -> DataFrame:
    """Rates of the outcomes, win rate, expectancy, excursions and holding."""
    return df.groupBy(*keys).agg(*_outcomes())


def summary_sets(df: DataFrame, keys: list[str], sides: list[str]) -> DataFrame:
    """The summary of each of the keys' values, over all of its rows and again by
    each of the sides, by grouping sets: one pass. `level` names the side ('all'
    for none), the other sides are NULL. Adds median, worst and best excursion,
    bars to each barrier and the Sharpe of a trade (population deviation)."""
    bars_to = lambda k: F.avg(F.when(C("outcome") == k, C("exit_bar")))
    more = [F.percentile("ret", 0.5).alias("median"), F.min("mae").alias("worst_mae"), F.max("mfe").alias("best_mfe"), bars_to("TP").alias("time_to_tp"),
            bars_to("SL").alias("time_to_sl"), (F.avg("ret") / (F.stddev_pop("ret") + 1e-12)).alias("sharpe")]
    d = df.groupingSets([keys, *[[*keys, x] for x in sides]], *keys, *sides).agg(*_outcomes(), *more, *[F.grouping(x).alias(f"_g_{x}") for x in sides])
    return d.withColumn("level", F.coalesce(*[F.when(C(f"_g_{x}") == 0, x) for x in sides], F.lit("all"))).drop(*[f"_g_{x}" for x in sides])


def bucket(p: Column, width: float = 0.05) -> Column:
    return F.floor(F.round(p / width, 9)).cast("int")


class Sleeves:
    """The book of one portfolio: each sleeve is either cash or one trade."""

    def __init__(self, k: int):
        self.cash = [1.0 / k] * k
        self.trade: list = [None] * k

    def free(self) -> list[int]:
        return [i for i, t in enumerate(self.trade) if t is None]

    def worth(self, day: int) -> float:
        return sum(c if t is None else c * t.mark(day) for c, t in zip(self.cash, self.trade, strict=True))

    def close(self, day: int) -> None:
        for i, t in enumerate(self.trade):
            if t is not None and t.days[-1] == day:
                self.cash[i] *= 1 + t.net
                self.trade[i] = None


class Trade:
    """A taken trade: the days of its path and its worth on each, the last one
    what it realises before costs."""

    def __init__(self, days: list[int], ratios: list[float], gross: float, net: float):
        self.days, self.worth, self.net = days, [*ratios[:-1], 1 + gross], net

    def mark(self, day: int) -> float:
        at = bisect.bisect_right(self.days, day) - 1
        return self.worth[at] if at >= 0 else 1.0


def slots(trades: DataFrame, dates: DataFrame, k: int, keys: list[str], per_day: int | None = None, cost: float = 0.0) -> DataFrame:
    """keys, ts, taken, won, held, equity for every date from a key's first entry
    to its last exit: capital lies in k sleeves that compound on their own; each
    day the best new trades by score (per_day at most) fill free sleeves, open
    trades are marked to their path, and exits free their sleeve for the next
    day. Trades are what barrier() makes; they enter on the first date of their
    path and pay `cost` per cent. dates: ts of all trading days. A day depends
    on the day before, so a key's trades are one group."""
    kinds = dict(trades.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", ts date, taken int, won int, held int, equity double"
    most = per_day or k

    def run(p: pd.DataFrame, cal: pd.DataFrame) -> pd.DataFrame:
        days = sorted(cal["ts"])
        at = {d: i for i, d in enumerate(days)}
        todo: dict[int, list] = {}
        last = -1
        for r in p.sort_values(["score", "symbol"], ascending=[False, True], kind="stable").itertuples():
            path = [at[d] for d in r.ahead[:r.exit_bar]]
            todo.setdefault(path[0], []).append(Trade(path, list(r.cr[:r.exit_bar]), r.ret / 100, (r.ret - cost) / 100))
            last = max(last, path[-1])
        book, rows = Sleeves(k), []
        for day in range(min(todo, default=0), last + 1):
            new = list(zip(book.free()[:most], todo.get(day, []), strict=False))
            for i, t in new:
                book.trade[i] = t
            rows.append((days[day], len(new), sum(t.net > 0 for _, t in new), k - len(book.free()), book.worth(day)))
            book.close(day)
        out = pd.DataFrame(rows, columns=["ts", "taken", "won", "held", "equity"])
        for i, c in enumerate(keys):
            out.insert(i, c, p[c].iloc[0] if len(p) else None)
        return out if len(p) else out.iloc[:0]

    need = trades.select(*keys, "symbol", "score", "ret", "exit_bar", "cr", "ahead")
    names = [f"_k{i}" for i in range(len(keys))]
    each = trades.select(*[C(c).alias(n) for c, n in zip(keys, names, strict=True)]).distinct().crossJoin(F.broadcast(dates.select("ts").distinct()))
    return need.groupBy(*keys).cogroup(each.groupBy(*names)).applyInPandas(run, schema)


def equity_stats(eq: DataFrame, keys: list[str], k: int, per_year: float = 252.0) -> DataFrame:
    """trades, win_rate, days, final, growth a year, Sharpe a year (population
    deviation), largest drawdown and mean share of sleeves in a trade, of daily
    equity that starts from a capital of 1 the day before."""
    p = Window.partitionBy(*keys).orderBy("ts")
    top = F.greatest(F.max("equity").over(p), F.lit(1.0))
    d = eq.withColumns({"_r": div(C("equity"), F.coalesce(F.lag("equity").over(p), F.lit(1.0))) - 1, "_fall": C("equity") / top - 1})
    d = d.groupBy(*keys).agg(F.sum("taken").alias("trades"), F.sum("won").alias("_won"), F.count("*").alias("days"), F.max_by("equity", "ts").alias("final"), F.avg("_r").alias("_m"),
                             F.stddev_pop("_r").alias("_s"), F.min("_fall").alias("_dd"), F.avg(C("held") / k).alias("exposure"))
    return d.select(*keys, "trades", div(C("_won"), C("trades")).alias("win_rate"), "days", "final", (F.pow(C("final"), per_year / C("days")) - 1).alias("growth"),
                    (C("_m") / (C("_s") + 1e-12) * per_year ** 0.5).alias("sharpe"), F.least(C("_dd"), F.lit(0.0)).alias("max_drawdown"), "exposure")


def top_k(df: DataFrame, score: str, y: str, k: int) -> DataFrame:
    """ts, n, ret, equity of the k best each date, equally weighted."""
    best = F.row_number().over(Window.partitionBy("ts").orderBy(C(score).desc(), "symbol"))
    d = df.where(C(y).isNotNull()).withColumn("_k", best).where(C("_k") <= k).groupBy("ts").agg(F.count("*").alias("n"), F.avg(y).alias("ret"))
    run = Window.partitionBy(F.lit("dates")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("equity", F.exp(F.sum(F.log(1 + C("ret"))).over(run)))


def held_top_k(df: DataFrame, score: str, horizon: int, k: int, cost: float) -> DataFrame:
    """ts, n, added, turnover, pnl, equity of a book that holds each date's k
    best by score: the mean return from the next bar's open to the close
    `horizon` bars after that, over the names that have both (0 if none has),
    less `cost` for turnover, the names that weren't held on the date before as
    a share of those that were. Dates without a score are no dates. Equity
    starts from 1 and ends with the book: NULL from a loss of all on."""
    d = df.withColumn("_r", div(w.lead(C("close"), 1 + horizon), w.lead(C("open"), 1)) - 1)
    best = F.row_number().over(Window.partitionBy("ts").orderBy(C(score).desc(), "symbol"))
    d = d.where(C(score).isNotNull()).withColumn("_k", best).where(C("_k") <= k)
    dates = Window.partitionBy(F.lit("dates")).orderBy("ts")
    places = d.select("ts").distinct().withColumn("_i", F.row_number().over(dates))
    d = d.join(places, "ts")
    was = F.lag("_i").over(Window.partitionBy("symbol").orderBy("_i"))
    d = d.withColumn("_new", F.coalesce(was != C("_i") - 1, F.lit(True)).cast("int"))
    d = d.groupBy("ts").agg(F.count("*").alias("n"), F.sum("_new").alias("added"), F.avg("_r").alias("_m"))
    d = d.withColumn("turnover", C("added") / F.coalesce(F.lag("n").over(dates), F.lit(1)))
    d = d.withColumn("pnl", F.coalesce("_m", F.lit(0.0)) - C("turnover") * cost)
    run = dates.rowsBetween(Window.unboundedPreceding, 0)
    alive = F.min(1 + C("pnl")).over(run) > 0
    return d.withColumn("equity", F.when(alive, F.exp(F.sum(F.when(C("pnl") > -1, F.log1p("pnl"))).over(run)))).drop("_m")
