"""Joins of a panel: slower context, as-of, grids and pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a table at most that a join may broadcast without asking Spark.
SMALL = 200_000


def small(df: DataFrame, limit: int = SMALL) -> DataFrame:
    """df with a broadcast hint if it has few rows, else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def with_context(panel: DataFrame, context: DataFrame, key: str, columns: list[str], symbol: str = "symbol", ts: str = "ts") -> DataFrame:
    """Left join of one row per key; gaps are filled forward per symbol."""
    d = panel.join(small(context.select(key, *columns)), key, "left")
    w = Window.partitionBy(symbol).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumns({c: F.last(c, True).over(w) for c in columns})


def asof(left: DataFrame, right: DataFrame, on: str, left_ts: str, right_ts: str, columns: list[str], strict: bool = True) -> DataFrame:
    """Backward as-of join: to each left row the latest right row of the key
    that is before it (strict) or not after it. Both sides are one sorted
    stream per key; right rows come after left rows of an equal time if strict,
    so one exchange and one sort do it, without comparing pairs. A right row
    overrides the ones before it, NULL values included; of right rows of one
    time the greatest counts."""
    keep = F.struct(*[F.col(c) for c in columns])
    kind = dict(left.select(F.col(left_ts)).dtypes)[left_ts]
    r = right.select(F.col(on).alias("_k"), F.col(right_ts).cast(kind).alias("_t"), F.lit(1 if strict else 0).alias("_o"), keep.alias("_v"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("s")).schema["s"].dataType).alias("_l"))
    lo = left.select(F.col(on).alias("_k"), F.col(left_ts).alias("_t"), F.lit(0 if strict else 1).alias("_o"), F.lit(None).cast(r.schema["_v"].dataType).alias("_v"), F.struct(*left.columns).alias("_l"))
    w = Window.partitionBy("_k").orderBy("_t", "_o", F.col("_v").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    d = lo.unionByName(r).withColumn("_v", F.last("_v", True).over(w)).where("_l is not null")
    return d.select("_l.*", *[F.col(f"_v.{c}").alias(c) for c in columns])


def chain(first: DataFrame, others: list[DataFrame], key: str) -> DataFrame:
    """Left joins of metric tables on one key."""
    return reduce(lambda a, b: a.join(b, key, "left"), others, first)


def pairs(ranked: DataFrame, name: str, rank: str) -> DataFrame:
    """a, b: every two of a short ranked list, the better one first. The list
    has to be short (top features): its size is checked."""
    if ranked.limit(1001).count() > 1000:
        raise ValueError("pairs() is for up to 1000 rows")
    a = ranked.select(F.col(name).alias("a"), F.col(rank).alias("_i"))
    b = F.broadcast(ranked.select(F.col(name).alias("b"), F.col(rank).alias("_j")))
    return a.join(b, F.col("_i") < F.col("_j")).select("a", "b")


def grid(df: DataFrame, **values: list[float]) -> DataFrame:
    """Every row with every combination of a few literal values, without a
    join."""
    for name, v in values.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(x) for x in v])))
    return df


def members(df: DataFrame, others: DataFrame, key: str, inside: bool = True) -> DataFrame:
    return df.join(others.select(key).distinct(), key, "left_semi" if inside else "left_anti")


def rows_of(keys: list[str], latest: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(latest))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new put in; of one key the newest row counts."""
    both = old.withColumn("_b", F.lit(0)).unionByName(new.withColumn("_b", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("_r", rows_of(keys, F.col("_b").desc())).where("_r = 1").drop("_r", "_b")
