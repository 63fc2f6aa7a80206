import datetime as dt

from pyspark.sql import functions as F

from panelforge.sources import files
from panelforge.streaming import bars as sb


def test_round_trip_partitions_and_frozen_schema(spark, tmp_path):
    d = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "ts int, symbol string, close double")
    p = str(tmp_path / "p")
    files.write_panel(d, p, by=["symbol"])
    files.write_panel(d.where("symbol = 'a'").withColumn("close", F.lit(9.0)), p, by=["symbol"])
    assert sorted((r.symbol, r.close) for r in files.read_columns(spark, p, ["symbol", "close"]).collect()) == [("a", 9.0), ("b", 2.0)]
    q = str(tmp_path / "q")
    files.append_frozen(d.withColumn("extra", F.lit(1)), q, ["ts", "symbol", "close", "late"])
    files.append_frozen(d.drop("close"), q, ["ts", "symbol", "close", "late"])
    got = spark.read.parquet(q)
    assert got.columns == ["ts", "symbol", "close", "late"] and got.count() == 4


def test_symbol_files_and_lists(spark, tmp_path):
    for s in ("ABC", "XYZ"):
        (tmp_path / "bars").mkdir(exist_ok=True)
        spark.range(2).toPandas().to_parquet(tmp_path / "bars" / f"{s}_daily.parquet")
    d = files.symbol_files(spark, str(tmp_path / "bars"))
    assert {r.symbol for r in d.collect()} == {"ABC", "XYZ"}
    assert files.symbol_files(spark, str(tmp_path / "bars"), like="^A").count() == 2
    assert files.symbol_files(spark, str(tmp_path / "bars"), like="^Q").count() == 0
    (tmp_path / "list.txt").write_text("Symbol\nabc, NSE:def-EQ\nABC\n\n")
    assert sorted(r.symbol for r in files.symbol_list(spark, str(tmp_path / "list.txt")).collect()) == ["ABC", "NSEdef-EQ"]


def test_csv_loader_and_rejects(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,close,volume\n2024-01-02,5,\nbad,1,1\n2024-01-01,x,3\n2024-01-02,6,4\n")
    got = sorted((r.timestamp.date(), r.close, r.volume) for r in files.load_any(spark, str(tmp_path / "a.csv")).collect())
    assert got == [(dt.date(2024, 1, 1), None, 3.0), (dt.date(2024, 1, 2), 6.0, 4.0)]
    d = spark.createDataFrame([("1", "x"), ("2", None)], "a string, b string")
    assert [r.bad for r in files.rejects(d, ["a", "b"]).collect()] == [["b"]]


def test_model_schema_suggestions_and_report(spark, tmp_path):
    files.save_schema(str(tmp_path / "s.json"), ["b", "a"], {"a": 1.5})
    assert files.load_schema(str(tmp_path / "s.json")) == (["b", "a"], {"a": 1.5})
    s = spark.createDataFrame([("INFY",)], "symbol string")
    i = spark.createDataFrame([("INFI",), ("IN",), ("TCS",)], "name string")
    assert sorted(r.name for r in files.suggestions(s, i).collect()) == ["IN", "INFI"]
    files.report_csv(i, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 3


def test_stream_to_upserted_bars(spark, tmp_path):
    src, out = tmp_path / "in", f"file://{tmp_path}/out"
    src.mkdir()
    t = lambda m: dt.datetime(2024, 1, 1, 9, m)
    schema = "event_id long, ts timestamp, event_type string, value double"
    run = sb.upsert_batch(out)

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{src}")
        q = (sb.stream_bars(spark.readStream.schema(schema).parquet(f"file://{src}")).writeStream.outputMode("update").foreachBatch(run)
             .option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start())
        q.awaitTermination()

    feed([(1, t(0), "x", 5.0), (2, t(1), "x", 7.0), (3, t(6), "x", 1.0)])
    feed([(4, t(2), "x", 9.0), (5, t(3), "y", 2.0)])
    got = sorted((r.symbol, r.ts.minute, r.open, r.high, r.close, r.volume) for r in sb.current(spark, out).collect())
    assert got == [("x", 0, 5.0, 9.0, 9.0, 3.0), ("x", 5, 1.0, 1.0, 1.0, 1.0), ("y", 0, 2.0, 2.0, 2.0, 1.0)]


def test_a_batch_rewrites_its_days_only(spark, tmp_path):
    out = f"file://{tmp_path}/t"
    run = sb.upsert_batch(out)
    t = lambda d, m: dt.datetime(2024, 1, d, 9, m)
    bars = lambda rows: spark.createDataFrame(rows, "symbol string, ts timestamp, close double")
    table = lambda: sorted((r.symbol, r.ts.day, r.ts.minute, r.close) for r in sb.current(spark, out).collect())
    assert sb.current(spark, out) is None
    run(bars([("x", t(1, 0), 1.0), ("x", t(2, 0), 2.0), ("x", t(3, 0), 3.0), ("x", None, 9.0)]), 0)
    run(bars([("x", t(2, 0), 5.0), ("y", t(2, 1), 6.0)]), 1)
    want = [("x", 1, 0, 1.0), ("x", 2, 0, 5.0), ("x", 3, 0, 3.0), ("y", 2, 1, 6.0)]
    days = lambda v: sorted(p.name for p in (tmp_path / "t" / f"v{v:010d}").glob("day=*"))
    assert table() == want and days(1) == ["day=2024-01-02"]
    run(bars([("x", t(2, 0), 5.0), ("y", t(2, 1), 6.0)]), 1)  # again
    assert table() == want
    run(bars([]), 2)
    assert table() == want and days(0) == ["day=2024-01-01", "day=2024-01-03"]
    # A version that wasn't written to its end doesn't count.
    run(bars([("x", t(1, 0), 7.0)]), 3)
    (tmp_path / "t" / "v0000000003" / "_SUCCESS").unlink()
    assert table() == want
    run(bars([("x", t(1, 0), 8.0)]), 3)
    assert table() == [("x", 1, 0, 8.0), *want[1:]]


def test_panel_of_one_table_or_of_files(spark, tmp_path):
    import pandas as pd
    import pytest

    (tmp_path / "f").mkdir()
    pd.DataFrame({"timestamp": ["2024-01-02 09:15", "bad"], "close": [1.0, 2.0]}).to_parquet(tmp_path / "f" / "AB_daily.parquet")
    pd.DataFrame({"timestamp": ["2024-01-03 00:00"], "close": [3.0], "extra": [7]}).to_parquet(tmp_path / "f" / "CD_daily.parquet")
    pd.DataFrame({"x": [1]}).to_parquet(tmp_path / "f" / "other.parquet")
    macro = spark.createDataFrame([(dt.date(2024, 1, 2), 5.0)], "date date, m double")
    d = files.load_panel(spark, str(tmp_path / "f"), per_symbol=True, macro=macro)
    assert sorted((r.symbol, str(r.date), r.close, r.m, r.extra) for r in d.collect()) == [("AB", "2024-01-02", 1.0, 5.0, None), ("CD", "2024-01-03", 3.0, None, 7)]
    one = str(tmp_path / "one.parquet")
    pd.DataFrame({"symbol": ["a", "b"], "timestamp": [None, "2024-02-01"], "date": ["2020-01-01", "2020-01-01"]}).to_parquet(one)
    assert [(r.symbol, str(r.date)) for r in files.load_panel(spark, one).collect()] == [("b", "2024-02-01")]
    with pytest.raises(ValueError, match="no column"):
        files.load_panel(spark, one, symbol="name")
    with pytest.raises(ValueError, match="panel has, too"):
        files.load_panel(spark, one, macro=macro.withColumn("symbol", F.lit(1)))


def test_recomputed_and_scored_panels(spark, tmp_path):
    import pytest

    d = spark.createDataFrame([("a", dt.date(2024, 1, 1), 2.0, 9.0), ("a", dt.date(2024, 1, 2), 4.0, 9.0)], "symbol string, ts date, close double, stale double")
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    files.write_panel(d, src)
    got = files.recompute(spark, src, out, lambda x: x.withColumn("twice", F.col("close") * 2))
    assert got.columns == ["symbol", "ts", "close", "twice"] and sorted(r.twice for r in got.collect()) == [4.0, 8.0]
    with pytest.raises(ValueError, match="source"):
        files.recompute(spark, src, src + "/", lambda x: x)
    scored = files.write_scored(d.withColumn("p", F.lit(0.25)), str(tmp_path / "scored"), "p")
    assert sorted(map(tuple, scored.collect()))[0] == ("a", dt.date(2024, 1, 1), 2.0, "bull_trend", 0.25)
    kept = files.write_scored(d.withColumns({"p": F.lit(1), "stock_regime": F.lit("bear_range")}), str(tmp_path / "s2"), "p")
    assert {r.stock_regime for r in kept.collect()} == {"bear_range"}
