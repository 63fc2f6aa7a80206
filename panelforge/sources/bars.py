"""Bars (symbol, time, open, high, low, close, volume) from transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ohlcv(rows: DataFrame, keys: dict[str, Column], price: Column, volume: Column, order: Column, first: str | None = None) -> DataFrame:
    """One bar for each key: first and last price in `order`, highest, lowest,
    total volume. Partial aggregates, one exchange on the keys; with `first`, a
    key, the rows are exchanged on it alone and later groups of it need no other
    (partial bars carry two orders and are wider than the rows they are made of)."""
    d = rows.select(*[c.alias(k) for k, c in keys.items()], price.alias("_p"), volume.alias("_v"), order.alias("_o")).where(F.col("_p").isNotNull())
    d = d.repartition(first) if first else d
    return d.groupBy(*keys).agg(
        F.min_by("_p", "_o").alias("open"), F.max("_p").alias("high"), F.min("_p").alias("low"),
        F.max_by("_p", "_o").alias("close"), F.sum("_v").alias("volume"))




def supplier_days(spark: SparkSession, sf_dir: str, first: str | None = None) -> DataFrame:
    """Daily bars: symbol is the supplier, price the unit price; `first` as in ohlcv()."""
    return ohlcv(table(spark, sf_dir, "lineitem"), {"symbol": F.col("l_suppkey"), "ts": F.to_date("l_shipdate")},
                 F.try_divide("l_extendedprice", "l_quantity"), F.col("l_quantity"), F.struct("l_orderkey", "l_linenumber", "l_partkey"), first)


def supplier_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bars of the same."""
    return ohlcv(table(spark, sf_dir, "lineitem"), {"symbol": F.col("l_suppkey"), "ts": F.to_date(F.trunc("l_shipdate", "month"))},
                 F.try_divide("l_extendedprice", "l_quantity"), F.col("l_quantity"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"))


def event_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of events: symbol is the type, a session is a day."""
    e = table(spark, sf_dir, "events")
    return ohlcv(e, {"symbol": F.col("event_type"), "ts": F.date_trunc("hour", "ts").cast("timestamp_ntz")}, F.col("value"), F.lit(1.0), F.struct("ts", "event_id"))


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of users: the wide cross-section."""
    e = table(spark, sf_dir, "events")
    return ohlcv(e, {"symbol": F.col("user_id"), "ts": F.to_date("ts")}, F.col("value"), F.lit(1.0), F.struct("ts", "event_id"))


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order date: mean order value and count."""
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("ts")).agg(
        F.avg("o_totalprice").alias("m_value"), F.count("*").alias("m_orders"))
