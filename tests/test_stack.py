"""Exponential means of closes that are all equal are equal but for their last
bits, and ema_stack has to follow the SQL there too."""

import datetime as dt

import duckdb
import numpy as np

from panelforge.plans import registry
from tests.oracle import connect, difference

DAY = dt.datetime(1995, 1, 3)


def trades(path, closes):
    """One trade a symbol and day; closes: a list of (quantity, price) each."""
    rows = [(s * 100 + k, 1, s, 1, float(q), float(p), 0.0, 0.0, "N", "O", DAY + dt.timedelta(days=k)) for s, c in enumerate(closes) for k, (q, p) in enumerate(c)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (l_orderkey BIGINT, l_linenumber INTEGER, l_suppkey BIGINT, l_partkey BIGINT, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag VARCHAR, l_linestatus VARCHAR, l_shipdate TIMESTAMP)")
    con.executemany("INSERT INTO t VALUES (" + ", ".join("?" * 11) + ")", rows)
    con.execute(f"COPY t TO '{path}/lineitem.parquet'")


def test_stack_of_equal_closes_is_the_sqls(spark, tmp_path):
    r = np.random.default_rng(3)
    price = lambda: (int(r.integers(1, 51)), round(float(r.uniform(900, 105000)), 2))
    up = lambda x: x / (1 - 2 / 21) * (1 - 2 / 21) > x / (1 - 2 / 51) * (1 - 2 / 51) > x / (1 - 2 / 101) * (1 - 2 / 101)
    found = []
    while len(found) < 6:
        q, p = price()
        if up(p / q):
            found.append((q, p))
    # Such a first bar alone, with other bars after it, and held for two bars; and plain ones.
    closes = [[f] for f in found[:2]] + [[f, price(), price()] for f in found[2:4]] + [[f, f, price()] for f in found[4:]] + [[price(), price()] for _ in range(6)]
    trades(tmp_path, closes)
    name, con = "d11_d22_momentum", connect(str(tmp_path))
    sql = registry.oracle_sql()[name]
    assert con.execute(f"SELECT count(*) FROM ({sql}) WHERE ts = DATE '1995-01-03' AND ema_stack = 1").fetchone()[0] >= 6
    assert difference(spark, con, str(tmp_path), registry.queries()[name], sql) == ""
