"""Compares queries with their SQL: python -m tests.oracle SF_DIR [NAME...]."""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys


def connect(sf: str):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(p).split(".")[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if hasattr(v, "as_tuple"):
        return float(v)
    return v + 0.0 if isinstance(v, float) else v


def difference(spark, con, sf: str, fn, sql: str) -> str:
    """Empty if the Spark query and the SQL return the same rows."""
    df = fn(spark, sf)
    cols = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    at = [names.index(c) for c in cols]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    if len(mine) != len(theirs):
        return f"{len(mine)} and {len(theirs)} rows"
    bad = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    return f"{len(bad)} of {len(mine)} rows differ: {cols} {bad[:2]}" if bad else ("no rows" if not mine else "")


if __name__ == "__main__":
    import time

    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "4")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, q = connect(sys.argv[1]), e.oracle_sql(), e.queries()
    for name in sys.argv[2:] or [k for k in q if not k.startswith("op") and k != "pipeline"]:
        t = time.time()
        try:
            if name in sql:
                said = difference(spark, con, sys.argv[1], q[name], sql[name]) or "same"
            else:
                said = f"no SQL, {q[name](spark, sys.argv[1]).count()} rows"
        except Exception as x:  # noqa: BLE001
            said = f"FAILED {type(x).__name__}: {str(x)[:600]}"
        print(f"{name}: {said} ({time.time() - t:.1f} s)", flush=True)
