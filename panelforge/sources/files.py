"""Reading and writing panels: projected scans, legacy per-symbol files,
manifests, schema files, incremental bars."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.functions.exprs import num
from panelforge.operators.cleaning import clean_symbol

BAR = ("open", "high", "low", "close", "volume")


def read_columns(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    d = spark.read.parquet(path)
    return d.select(*columns) if columns else d


def write_panel(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite", rows: int = 250_000) -> None:
    """Snappy Parquet through the committer (a failed write leaves nothing);
    with partition columns only the partitions written are replaced."""
    w = df.write.mode(mode).option("compression", "snappy").option("maxRecordsPerFile", rows)
    if by:
        w = w.option("partitionOverwriteMode", "dynamic").partitionBy(*by)
    w.parquet(path)


def append_frozen(df: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """The frozen columns in order, missing ones NULL, later extras left out,
    appended; returns what was written."""
    kinds = dict(df.dtypes)
    out = df.select(*[F.col(c) if c in kinds else F.lit(None).cast("double").alias(c) for c in columns])
    out.write.mode("append").parquet(path)
    return out


def symbol_files(spark: SparkSession, path: str, pattern: str = r"(.+)_(?:daily|5min)\.parquet$", like: str | None = None, glob: str = "*.parquet", merge: bool = False) -> DataFrame:
    """Per-symbol files as one table; the symbol is in the file's name. A
    filter that fits no file gives no rows."""
    d = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("mergeSchema", merge).parquet(path)
    d = d.withColumn("symbol", F.regexp_extract(F.col("_metadata.file_name"), pattern, 1)).where("symbol != ''")
    return d.where(F.col("symbol").rlike(like)) if like else d


def load_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV or Parquet bars: `date` is renamed, bad numbers become NULL, rows
    without time go, of one time the last row counts."""
    if path.rstrip("/").endswith(".csv"):
        r = spark.read.option("header", True)
        d = (r.schema(schema) if schema else r).csv(path)
    else:
        d = spark.read.parquet(path)
    if "timestamp" not in d.columns and "date" in d.columns:
        d = d.withColumnRenamed("date", "timestamp")
    return normalize(d, "timestamp")


def normalize(df: DataFrame, ts: str = "timestamp", keys: tuple[str, ...] = ()) -> DataFrame:
    """Time as a timestamp, numbers as doubles, one row (the last that was
    read) for each key and time, columns in their usual order."""
    d = df.withColumn(ts, F.col(ts).try_cast("timestamp")).where(F.col(ts).isNotNull())
    d = d.withColumns({c: num(F.col(c)) for c in BAR if c in d.columns})
    if "volume" in d.columns:
        d = d.withColumn("volume", F.coalesce("volume", F.lit(0.0)))
    last = F.row_number().over(Window.partitionBy(*keys, ts).orderBy(F.monotonically_increasing_id().desc()))
    d = d.withColumn("_k", last).where("_k = 1").drop("_k")
    first = [*keys, ts, *[c for c in BAR if c in d.columns]]
    return d.select(*first, *[c for c in d.columns if c not in first])


def load_panel(spark: SparkSession, path: str, per_symbol: bool = False, ts: str | None = None, symbol: str = "symbol", macro: DataFrame | None = None) -> DataFrame:
    """The panel with `symbol` and `date`, from one table (a column of symbols
    and one of time, `timestamp` before `date`) or from a folder of SYMBOL_daily
    files (`date` before `timestamp`; their columns may differ). Rows without a
    date go. macro: one row for each `date`, left-joined; its columns must have
    names of their own."""
    order = ("date", "timestamp") if per_symbol else ("timestamp", "date")
    if per_symbol:
        d = symbol_files(spark, path, glob="*_daily.parquet", merge=True)
    else:
        d = spark.read.parquet(path)
        if symbol not in d.columns:
            raise ValueError(f"no column {symbol!r} in {path}")
        d = d.withColumnRenamed(symbol, "symbol")
    at = ts or next((c for c in order if c in d.columns), None)
    if at is None:
        raise ValueError(f"no timestamp or date in {path}")
    d = d.withColumn("date", F.to_date(F.col(at).try_cast("timestamp"))).where("date is not null")
    d = d.drop(at) if per_symbol and at != "date" else d
    if macro is None:
        return d
    both = (set(d.columns) & set(macro.columns)) - {"date"}
    if both:
        raise ValueError(f"macro columns that the panel has, too: {sorted(both)}")
    return d.join(macro.withColumn("date", F.to_date("date")), "date", "left")


def recompute(spark: SparkSession, source: str, target: str, transform, by: list[str] | None = None) -> DataFrame:
    """The stored bars' key and OHLCV columns (indicators that were stored with
    them are left out) with the transform applied anew, written to another
    folder and read back."""
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("the target is the source")
    d = spark.read.parquet(source)
    write_panel(transform(d.select(*[c for c in d.columns if c in ("symbol", "ts", *BAR)])), target, by)
    return spark.read.parquet(target)


def write_scored(df: DataFrame, path: str, prob: str, regime: str = "stock_regime", ts: str = "ts") -> DataFrame:
    """symbol, ts, close (if there), stock_regime (`bull_trend` where the panel
    has none) and prob_5d_mean of every row, written as Parquet and read back.
    Rows are scored where they lie, so no batch has to fit in memory."""
    keep = [c for c in ("symbol", ts, "close") if c in df.columns]
    how = F.col(regime) if regime in df.columns else F.lit("bull_trend")
    write_panel(df.select(*keep, how.alias("stock_regime"), F.col(prob).cast("double").alias("prob_5d_mean")), path)
    return df.sparkSession.read.parquet(path)


def manifest(df: DataFrame, ts: str) -> DataFrame:
    """One row: count, first and last time, share of NULLs of each column."""
    rest = [c for c in df.columns if c != ts]
    return df.agg(F.count("*").alias("rows"), F.min(ts).alias("first"), F.max(ts).alias("last"), *[F.avg(F.col(c).isNull().cast("double")).alias(f"null_{c}") for c in rest])


def rejects(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with text that is no number in one of the columns, and which."""
    bad = F.filter(F.array(*[F.when(F.col(c).isNotNull() & num(F.col(c)).isNull(), F.lit(c)) for c in columns]), lambda c: c.isNotNull())
    return df.withColumn("bad", bad).where(F.size("bad") > 0)


def symbol_list(spark: SparkSession, path: str) -> DataFrame:
    """Symbols of a text or CSV list: cells, cleaned, heading words left out,
    once whatever their case."""
    words = F.split("value", r"[,;\t]")
    d = spark.read.text(path).select(F.explode(words).alias("raw")).select(clean_symbol(F.col("raw")).alias("symbol"))
    return d.where("symbol is not null").groupBy(F.upper("symbol").alias("_s")).agg(F.min("symbol").alias("symbol")).drop("_s")


def resolve(symbols: DataFrame, instruments: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """symbol, token, how: an override, an exact name, the name with -EQ, or the
    same letters and digits; the smallest token of equals."""
    base = lambda c: F.regexp_replace(F.upper(c), r"(-EQ|-BE)$|[^A-Z0-9]", "")
    one = instruments.groupBy(F.upper("name").alias("_n")).agg(F.min("token").alias("_t"))
    loose = instruments.groupBy(base(F.col("name")).alias("_n")).agg(F.min("token").alias("_t"))
    d = symbols.select("symbol", F.upper("symbol").alias("_s"))
    found = []
    if overrides is not None:
        o = overrides.select(F.upper("symbol").alias("_n"), F.col("token").alias("_t"))
        found.append(("override", F.col("_s"), o))
    found += [("exact", F.col("_s"), one), ("suffix", F.concat("_s", F.lit("-EQ")), one), ("base", base(F.col("_s")), loose)]
    for how, key, table in found:
        t = table.select(F.col("_n").alias(f"_n_{how}"), F.col("_t").alias(f"_t_{how}"))
        d = d.join(t, key == F.col(f"_n_{how}"), "left")
    names = [h for h, _, _ in found]
    return d.select("symbol", F.coalesce(*[F.col(f"_t_{h}") for h in names]).alias("token"), F.coalesce(*[F.when(F.col(f"_t_{h}").isNotNull(), h) for h in names]).alias("how"))


def suggestions(symbols: DataFrame, instruments: DataFrame, distance: int = 2) -> DataFrame:
    """symbol, name: names that differ by few letters, of the same first letter
    and nearly the same length (so it is a keyed join)."""
    a = symbols.select("symbol", F.upper("symbol").alias("_s")).withColumn("_f", F.substring("_s", 1, 1)).withColumn("_l", F.explode(F.sequence(F.length("_s") - distance, F.length("_s") + distance)))
    b = instruments.select("name", F.upper("name").alias("_m")).withColumn("_g", F.substring("_m", 1, 1)).withColumn("_k", F.length("_m"))
    return a.join(b, (a._f == b._g) & (a._l == b._k) & (F.levenshtein("_s", "_m") <= distance)).select("symbol", "name")


def save_schema(path: str, features: list[str], impute: dict[str, float]) -> None:
    """Model schema: features in order, medians. A small driver-side file."""
    with open(path, "w") as f:
        json.dump({"features": features, "impute": impute}, f, indent=1)


def load_schema(path: str) -> tuple[list[str], dict[str, float]]:
    with open(path) as f:
        d = json.load(f)
    return d["features"], d["impute"]


def fetch_plan(df: DataFrame, days: int) -> DataFrame:
    """symbol, first, last: date ranges of at most `days` that cover first to
    last of each row."""
    d = df.withColumn("_a", F.explode(F.sequence("first", "last", F.expr(f"INTERVAL {days} DAYS"))))
    return d.select("symbol", F.col("_a").alias("first"), F.least(F.date_add("_a", days - 1), F.col("last")).alias("last"))


def report_csv(df: DataFrame, path: str) -> None:
    """A report is small: one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
