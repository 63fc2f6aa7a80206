"""Filters, cleaning and column discovery."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.functions.exprs import gate, num, roll, so_far

#: Date formats in the order in which they are tried, and words
#: of a symbol list that are headings.
DATE_FORMATS = ("yyyy-M-d", "d-M-yyyy", "d/M/yyyy", "M/d/yyyy", "d.M.yyyy")
HEADINGS = ("symbol", "symbols", "ticker", "tickers", "scrip", "scrips", "name")


def liquid(df: DataFrame, floor: float, volume: float, bars: int = 20) -> DataFrame:
    """Rows at or above a price floor and a rolling mean volume."""
    d = df.withColumn("_m", F.avg("volume").over(roll(bars)))
    return d.where((F.col("close") >= floor) & (F.col("_m") >= volume)).drop("_m")


def tradeable(floor: float, turnover: float, bars: int = 20) -> Column:
    """Flag: price floor and rolling mean turnover, known after half the bars."""
    t = F.col("close") * F.col("volume")
    return F.coalesce((gate(F.avg(t), t, roll(bars), bars // 2) >= turnover) & (F.col("close") >= floor), F.lit(False))


def fresh(df: DataFrame, days: int) -> DataFrame:
    """Symbols whose last bar is within `days` of the last of all."""
    last = df.groupBy("symbol").agg(F.max("ts").alias("_last"))
    top = F.broadcast(last.agg(F.max("_last").alias("_top")))
    keep = last.crossJoin(top).where(F.datediff("_top", "_last") <= days).select("symbol")
    return df.join(keep, "symbol", "left_semi")


def monotonic_errors(df: DataFrame) -> DataFrame:
    """Rows whose time isn't after the one before (repeated times included)."""
    prev = F.lag("ts").over(Window.partitionBy("symbol").orderBy("ts"))
    return df.withColumn("_p", prev).where(F.col("ts") <= F.col("_p")).drop("_p")


def fill_forward(df: DataFrame, columns: list[str]) -> DataFrame:
    """Last known value, 0 before any."""
    w = so_far("symbol")
    return df.withColumns({c: F.coalesce(F.last(c, True).over(w), F.lit(0.0)) for c in columns})


def bool_text(c: Column) -> Column:
    """'true' and 'false' in any case become 1 and 0, other text a number."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t == "true", 1.0).when(t == "false", 0.0).otherwise(num(t))


def impute(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """Missing values get the exact median of the training rows only."""
    m = df.where(train).agg(*[F.percentile(c, 0.5).alias(f"_m_{c}") for c in columns])
    d = df.crossJoin(F.broadcast(m))
    return d.withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in columns}).drop(*[f"_m_{c}" for c in columns])


def one_hot(c: Column, values: list, prefix: str) -> dict[str, Column]:
    """A complete family of 0/1 columns, whatever occurs."""
    return {f"{prefix}_{v}": F.coalesce((c == F.lit(v)).cast("int"), F.lit(0)) for v in values}


def clean_symbol(c: Column) -> Column:
    """The name with a byte-order mark and characters that files can't have
    taken out and white space as single spaces, its case as it is; NULL where
    nothing is left or it is a heading."""
    s = F.regexp_replace(F.regexp_replace(c.cast("string"), "\x00", ""), "^\uFEFF+", "")
    s = F.trim(F.regexp_replace(s, r"(?U)\s+", " "))
    s = F.regexp_replace(s, r'[<>:"/?*]', "")
    return F.when((s != "") & ~F.lower(F.trim(s)).isin(*HEADINGS), s)


def parse_date(c: Column) -> Column:
    """The first of five formats that fits."""
    return F.coalesce(*[F.to_date(F.try_to_timestamp(F.trim(c), F.lit(f))) for f in DATE_FORMATS])


def date_range(start: Column, end: Column, today: Column) -> dict[str, Column]:
    """first and last of a range given as text in either order, neither after
    today."""
    a, b = parse_date(start), parse_date(end)
    known = a.isNotNull() & b.isNotNull()
    return {"first": F.when(known, F.least(a, b, today)), "last": F.when(known, F.least(F.greatest(a, b), today))}


def discover(df: DataFrame, prefixes: tuple[str, ...], deny: tuple[str, ...], known: float = 0.3, distinct: int = 5) -> list[str]:
    """Numeric columns by prefix, without denied patterns, that are known often
    enough and vary; one aggregate for all of them."""
    kinds = dict(df.dtypes)
    names = [c for c in df.columns if c.startswith(prefixes) and kinds[c] in ("double", "float", "int", "bigint", "smallint", "tinyint") and not any(re.search(p, c) for p in deny)]
    if not names:
        return []
    row = df.agg(*[F.struct(F.avg(F.col(c).isNotNull().cast("double")), F.count_distinct(c)).alias(c) for c in names]).first()
    return [c for c in names if (row[c][0] or 0) >= known and row[c][1] > distinct]


def pick_column(columns: list[str], candidates: list[str]) -> str | None:
    """The first candidate there is, whatever its case."""
    have = {c.lower(): c for c in columns}
    return next((have[c.lower()] for c in candidates if c.lower() in have), None)


def unique_names(columns: list[str]) -> list[str]:
    """Repeated names get __dup1, __dup2, ..."""
    seen: dict[str, int] = {}
    out = []
    for c in columns:
        k = seen.get(c, 0)
        out.append(c if not k else f"{c}__dup{k}")
        seen[c] = k + 1
    return out


def no_labels(features: list[str], patterns: tuple[str, ...] = (r"^ret_\d+d", r"^fwd_", r"_fwd$", r"^label", r"^mfe_", r"^mae_", r"^rank_\d+d", r"^top\d+_")) -> None:
    """Raises if a label is among the features."""
    bad = [f for f in features if any(re.search(p, f) for p in patterns)]
    if bad:
        raise ValueError(f"labels among the features: {bad}")


def local_time(c: Column, zone: str) -> Column:
    """The wall clock of a UTC time in a zone, without a zone of its own."""
    return F.from_utc_timestamp(c, zone).cast("timestamp_ntz")


def local_date(c: Column, zone: str) -> Column:
    """The date there; a local midnight stays on its own day."""
    return F.to_date(F.from_utc_timestamp(c, zone))


def exclude(df: DataFrame, pattern: str, column: str = "symbol") -> DataFrame:
    """Rows whose name doesn't fit the pattern; NULL names stay."""
    return df.where(~F.coalesce(F.col(column).cast("string").rlike(pattern), F.lit(False)))


def out_of_range(df: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """One row: how many values of each column lie outside its limits."""
    return df.agg(*[F.count_if(~F.col(c).between(*lim)).alias(c) for c, lim in limits.items()])


def merged(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Columns that mean the same as one; the last that is known wins."""
    return df.withColumn(name, F.coalesce(*[F.col(c) for c in reversed(columns)])).drop(*[c for c in columns if c != name])


def without(df: DataFrame, names: tuple[str, ...] = (), patterns: tuple[str, ...] = ()) -> DataFrame:
    """df without the named columns and those that fit a pattern; names that
    aren't there don't matter."""
    gone = [c for c in df.columns if c in names or any(re.search(p, c) for p in patterns)]
    return df.drop(*gone)


def narrowed(df: DataFrame) -> DataFrame:
    """Doubles as floats, for storage that may lose the last digits."""
    return df.select(*[F.col(c).cast("float").alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])
