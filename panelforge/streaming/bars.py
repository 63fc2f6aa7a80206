"""Bars from a stream, with late rows up to a watermark, and an idempotent
upsert of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators.joins import upsert


def stream_bars(events: DataFrame, width: str = "5 minutes", late: str = "1 day", symbol: str = "event_type", ts: str = "ts", price: str = "value", order: str = "event_id") -> DataFrame:
    """Bars of a (streaming or batch) table of trades, by event time."""
    d = events.withWatermark(ts, late) if events.isStreaming else events
    at = F.struct(F.col(ts), F.col(order))
    g = d.groupBy(F.window(ts, width).alias("w"), F.col(symbol).alias("symbol")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count("*").cast("double").alias("volume"))
    return g.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def upsert_batch(path: str):
    """For foreachBatch: the batch's bars replace stored ones of the same symbol
    and time. Only the days a batch touches (few, as the watermark bounds them)
    are read and written anew, under the batch's number, so a batch costs its
    days and not the table; of each day the newest whole version counts. A batch
    run again gives the same table. Days that an earlier batch has superseded
    are deleted when the next one starts: a reader has the time of a whole batch
    to end. Bars without a time are left out."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        days = _days(spark, path, number, sweep=True)
        new = batch.where("ts is not null").withColumn("day", F.to_date("ts")).persist()
        try:
            touched = [days[d] for r in new.select("day").distinct().collect() if (d := str(r.day)) in days]
            out = upsert(spark.read.schema(batch.schema).parquet(*touched), new.drop("day"), ["symbol", "ts"]).withColumn("day", F.to_date("ts")) if touched else new
            out.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(f"{path}/v{number:010d}")
        finally:
            new.unpersist()

    return run


def _days(spark: SparkSession, path: str, before: int | None = None, sweep: bool = False) -> dict[str, str]:
    """The folder of each day's newest whole version (before a batch number);
    with sweep the older ones go."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at(path)):
        return {}
    found: dict[str, str] = {}
    for v in sorted((s.getPath() for s in fs.listStatus(at(path))), key=lambda v: v.getName(), reverse=True):
        if not fs.exists(at(v, "_SUCCESS")) or (before is not None and v.getName() >= f"v{before:010d}"):
            continue
        held = [s.getPath() for s in fs.listStatus(v) if s.getPath().getName().startswith("day=")]
        old = [d for d in held if d.getName()[4:] in found]
        found.update({d.getName()[4:]: d.toString() for d in held if d not in old})
        if sweep:
            for d in old:
                fs.delete(d, True)
            if len(old) == len(held):
                fs.delete(v, True)
    return found


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as it stands: every day's newest whole version."""
    days = _days(spark, path)
    return spark.read.parquet(*days.values()) if days else None
