"""Pieces of DuckDB SQL that the oracle queries share."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from panelforge.operators.aggregates import quantile_points

#: Results are compared rounded to four places. Exact ties (means of a few
#: prices) would round by the last bit, so both sides are moved off them.
NUDGE = 3.7e-7


def rd(**cols):
    """Columns as they are compared; `round(x, 4)` in the SQL (see exact)."""
    return [F.round(c + F.lit(NUDGE), 4).alias(k) for k, c in cols.items()]


def exact(sql: str) -> str:
    return sql.replace(", 4)", f" + {NUDGE}, 4)")


_P = "(SELECT *, l_extendedprice / nullif(l_quantity, 0) AS p FROM lineitem) WHERE p IS NOT NULL"
_K = "l_orderkey, l_linenumber, l_partkey"

BARS = f"""bars AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS ts, first(p ORDER BY {_K}) AS open, max(p) AS high,
 min(p) AS low, last(p ORDER BY {_K}) AS close, sum(l_quantity) AS volume FROM {_P} GROUP BY 1, 2)"""
MONTHS = f"""bars AS (SELECT l_suppkey AS symbol, CAST(date_trunc('month', l_shipdate) AS DATE) AS ts, first(p ORDER BY l_shipdate, {_K}) AS open,
 max(p) AS high, min(p) AS low, last(p ORDER BY l_shipdate, {_K}) AS close, sum(l_quantity) AS volume FROM {_P} GROUP BY 1, 2)"""
HOURS = """bars AS (SELECT event_type AS symbol, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, first(value ORDER BY events.ts, event_id) AS open,
 max(value) AS high, min(value) AS low, last(value ORDER BY events.ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
 FROM events WHERE value IS NOT NULL GROUP BY 1, 2)"""
USERS = """bars AS (SELECT user_id AS symbol, CAST(ts AS DATE) AS ts, first(value ORDER BY events.ts, event_id) AS open, max(value) AS high,
 min(value) AS low, last(value ORDER BY events.ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
 FROM events WHERE value IS NOT NULL GROUP BY 1, 2)"""
MACRO = """macro AS (SELECT CAST(o_orderdate AS DATE) AS ts, avg(o_totalprice) AS m_value, count(*) AS m_orders FROM orders GROUP BY 1)"""

P = "(PARTITION BY symbol ORDER BY ts)"
CUM = "(PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"


def r(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(agg: str, x: str, n: int, least: int) -> str:
    """agg with {x} in it, over the last n rows, from `least` values on."""
    return f"CASE WHEN count({x}) OVER {r(n)} >= {least} THEN {agg} OVER {r(n)} END"


def nn(x: str) -> str:
    return f"(SELECT CASE WHEN isnan(v) THEN NULL ELSE v END FROM (SELECT {x} AS v))"


def xs_rank(x: str, keys: str, pct: bool = True) -> str:
    n = f" / count({x}) OVER (PARTITION BY {keys})" if pct else ""
    return (f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {keys} ORDER BY {x} NULLS LAST) "
            f"+ (count({x}) OVER (PARTITION BY {keys}, {x}) - 1) / 2){n} END")


def ewm(x: str, alpha: float, least: int, source: str = "bars") -> tuple[str, str]:
    """(recursive CTE, name): y by symbol and ts; x may be NULL at the head
    only."""
    name = "e" + format(zlib.crc32(f"{x}|{alpha}|{source}".encode()), "x")
    return (f"""{name}_b AS (SELECT symbol, ts, {x} AS x, row_number() OVER {P} AS rn, count({x}) OVER {CUM} AS k FROM {source}),
{name} AS (SELECT symbol, ts, rn, k, x AS y FROM {name}_b WHERE k = 1 AND x IS NOT NULL
 UNION ALL SELECT b.symbol, b.ts, b.rn, b.k, CASE WHEN b.x IS NULL THEN e.y ELSE {1 - alpha!r} * e.y + {alpha!r} * b.x END FROM {name} e JOIN {name}_b b ON b.symbol = e.symbol AND b.rn = e.rn + 1)""", name)


def smooth(x: str, alpha: float, source: str = "bars") -> tuple[str, str]:
    """(CTE, name): the exponential mean y of x (NULL at the head only) and the
    number k of values so far, as a weighted sum instead of a recursion."""
    name = "s" + format(zlib.crc32(f"{x}|{alpha}|{source}".encode()), "x")
    return (f"""{name}_b AS (SELECT symbol, ts, {x} AS x, count({x}) OVER {CUM} AS k FROM {source}),
{name} AS (SELECT symbol, ts, k, CASE WHEN k > 0 THEN pow({1 - alpha!r}, k) * sum(CASE WHEN x IS NULL THEN 0 WHEN k = 1 THEN x / {1 - alpha!r} ELSE {alpha!r} * x * pow({1 - alpha!r}, -k) END)
 OVER {CUM} END AS y FROM {name}_b)""", name)


def oscillators() -> str:
    """CTEs up to osc: the bars with ema20, ema50, ema100, macd, macd_signal,
    rsi7, rsi14, atr14 and adx14."""
    ctes = [f"""mv AS (SELECT symbol, ts, close - lag(close) OVER {P} AS st, high - lag(high) OVER {P} AS up, lag(low) OVER {P} - low AS dn,
 greatest(high - low, abs(high - lag(close) OVER {P}), abs(low - lag(close) OVER {P})) AS tr FROM bars)"""]
    names = {}

    def add(key, x, alpha, source="bars"):
        cte, names[key] = smooth(x, alpha, source)
        ctes.append(cte)

    for n in (20, 50, 100, 12, 26):
        add(f"e{n}", "close", 2 / (n + 1))
    ctes.append(f"mc AS (SELECT a.symbol, a.ts, a.y - b.y AS v FROM {names['e12']} a JOIN {names['e26']} b USING (symbol, ts))")
    add("signal", "v", 0.2, "mc")
    for n in (7, 14):
        add(f"gain{n}", "greatest(st, CASE WHEN st IS NULL THEN NULL ELSE 0 END)", 1 / n, "mv")
        add(f"loss{n}", "CASE WHEN st IS NULL THEN NULL ELSE -least(st, 0) END", 1 / n, "mv")
    add("tr", "tr", 1 / 14, "mv")
    add("plus", "CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END", 1 / 14, "mv")
    add("minus", "CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END", 1 / 14, "mv")
    ctes.append(f"""di AS (SELECT t.symbol, t.ts, t.k, 100 * p.y / nullif(t.y, 0) AS pdi, 100 * m.y / nullif(t.y, 0) AS mdi
 FROM {names['tr']} t JOIN {names['plus']} p USING (symbol, ts) JOIN {names['minus']} m USING (symbol, ts)),
dx AS (SELECT symbol, ts, CASE WHEN k >= 14 THEN 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) END AS v FROM di)""")
    add("adx", "v", 1 / 14, "dx")
    rsi = lambda n: f"CASE WHEN g{n}.k >= {n} THEN 100 - 100 / (1 + g{n}.y / nullif(l{n}.y, 0)) END AS rsi{n}"
    ctes.append(f"""osc AS (SELECT bars.*, a.y AS ema20, b.y AS ema50, c.y AS ema100, mc.v AS macd, s.y AS macd_signal, {rsi(7)}, {rsi(14)},
 CASE WHEN t.k >= 14 THEN t.y END AS atr14, CASE WHEN x.k >= 14 THEN x.y END AS adx14 FROM bars
 JOIN {names['e20']} a USING (symbol, ts) JOIN {names['e50']} b USING (symbol, ts) JOIN {names['e100']} c USING (symbol, ts) JOIN mc USING (symbol, ts) JOIN {names['signal']} s USING (symbol, ts)
 JOIN {names['gain7']} g7 USING (symbol, ts) JOIN {names['loss7']} l7 USING (symbol, ts) JOIN {names['gain14']} g14 USING (symbol, ts) JOIN {names['loss14']} l14 USING (symbol, ts)
 JOIN {names['tr']} t USING (symbol, ts) JOIN {names['adx']} x USING (symbol, ts))""")
    return ", ".join(ctes)


def normal_cdf(z: str) -> str:
    """The normal distribution function by its power series (for |z| < 8)."""
    term = f"exp((2 * i + 1) * ln(greatest(abs({z}), 1e-200)) - (i + 1) * ln(2) - lgamma(i + 1.5) + 0.5 * ln(pi()))"
    return f"CASE WHEN {z} > 8 THEN 1.0 WHEN {z} < -8 THEN 0.0 ELSE 0.5 + sign({z}) * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 120), lambda i: {term})) END"


def rank_bucket(q: int, n: str, r: str) -> str:
    points = ", ".join(repr(p) for p in quantile_points(q))
    return f"CAST(greatest(len(list_filter(CAST([{points}] AS DOUBLE[]), lambda q: 1 + ({n} - 1) * q < {r})), 1) AS INTEGER)"
