"""Grouped statistics: quantile buckets, bucket reports, breadth, survival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.functions.exprs import div


def edges(df: DataFrame, x: str, q: int, *keys: str) -> DataFrame:
    """The distinct inner and outer quantiles of x for each key (or in all)."""
    cut = F.array_sort(F.array_distinct(F.percentile(x, F.array(*[F.lit(k / q) for k in range(q + 1)])))).alias("_edges")
    return df.groupBy(*keys).agg(cut)


def value_bucket(x: Column, cuts: Column) -> Column:
    """Right-closed bucket from 1 of x between cuts; the least belongs to 1."""
    return F.when(x.isNotNull(), F.greatest(F.size(F.filter(cuts, lambda e: e < x)), F.lit(1)))


def with_value_bucket(df: DataFrame, x: str, q: int, name: str) -> DataFrame:
    """Equal quantiles by value; duplicate cuts are dropped. The cuts are one
    row, joined by broadcast."""
    return df.crossJoin(F.broadcast(edges(df, x, q))).withColumn(name, value_bucket(F.col(x), F.col("_edges"))).drop("_edges")


def quantile_points(q: int) -> list[float]:
    """The lower q of q + 1 even quantiles, in the arithmetic of percentages."""
    return [k * (1.0 / q) * 100.0 / 100.0 for k in range(q)]


def rank_bucket(x: Column, q: int, *keys: str, ties: tuple[str, ...] = ()) -> Column:
    """Equal counts: rows are numbered by x (ties by the given columns) and the
    linear quantiles of 1..n cut the numbers, within the keys."""
    w = Window.partitionBy(*keys)
    r = F.row_number().over(w.orderBy(x, *ties))
    n = F.count(x).over(w)
    below = F.size(F.filter(F.array(*[F.lit(p) for p in quantile_points(q)]), lambda p: 1 + (n - 1) * p < r))
    return F.when(x.isNotNull(), F.greatest(below, F.lit(1)))


def report(df: DataFrame, ret: str, *keys: str) -> DataFrame:
    """Count, win rate, mean, mean win and loss, median, spread and Sharpe."""
    r = F.col(ret)
    d = df.groupBy(*keys).agg(F.count(r).alias("n"), F.avg((r > 0).cast("double")).alias("win_rate"), F.avg(r).alias("mean"), F.avg(F.when(r > 0, r)).alias("mean_win"),
                              F.avg(F.when(r <= 0, r)).alias("mean_loss"), F.percentile(r, 0.5).alias("median"), F.stddev_pop(r).alias("spread"))
    return d.withColumn("sharpe", div(F.col("mean"), F.col("spread")))


def scopes(df: DataFrame, oos: Column) -> DataFrame:
    """Rows for the full scope, and again for the out-of-sample one."""
    return df.withColumn("scope", F.explode(F.when(oos, F.array(F.lit("Full"), F.lit("OOS"))).otherwise(F.array(F.lit("Full")))))


def at_least(df: DataFrame, x: str, thresholds: list[float]) -> DataFrame:
    """Rows under every threshold that x reaches; a row goes to as many as it
    reaches, nothing is joined."""
    hit = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.col(x) >= t)
    return df.withColumn("threshold", F.explode(hit))


def survivors(df: DataFrame, days: int) -> DataFrame:
    """One row: symbols, and the share still quoted near the last date."""
    last = df.groupBy("symbol").agg(F.max("ts").alias("last"))
    top = last.agg(F.max("last").alias("top"))
    return last.crossJoin(F.broadcast(top)).agg(F.count("*").alias("symbols"), F.avg((F.datediff("top", "last") <= days).cast("double")).alias("alive"))


def breadth(df: DataFrame, least: int) -> DataFrame:
    """One row: dates, median names a date, dates with fewer than `least`."""
    return df.groupBy("ts").agg(F.countDistinct("symbol").alias("n")).agg(
        F.count("*").alias("dates"), F.percentile("n", 0.5).alias("median_names"), F.count_if(F.col("n") < least).alias("thin"))
