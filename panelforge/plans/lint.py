"""Leak checks: a plan lint for windows that look ahead, and a tamper test."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def forward_windows(df: DataFrame) -> list[str]:
    """Window frames of the analysed plan that reach past the row, and frames
    over a whole series without an order, as text."""
    plan = df._jdf.queryExecution().analyzed().toString()
    frames = re.findall(r"windowspecdefinition\(((?:[^()]|\([^()]*\))*)\)", plan)
    out = []
    for f in frames:
        if re.search(r"specifiedwindowframe\((?:Row|Range)Frame, [^,]+, (?:unboundedfollowing\$\(\)|[1-9])", f) and "symbol" in f:
            out.append(f.strip())
    out += [m for m in re.findall(r"lead\([^)]*\)", plan)]
    out += [m for m in re.findall(r"lag\([^,]+, -\d+[^)]*\)", plan) if not re.search(r"lag\([^,]+, -[1-9]\d*, ", m)]
    return out


def tampered(df: DataFrame, since, columns=("open", "high", "low", "close", "volume"), factor: float = 7.0) -> DataFrame:
    """The same bars with everything from a time on changed."""
    late = F.col("ts") >= F.lit(since)
    return df.withColumns({c: F.when(late, F.col(c) * factor).otherwise(F.col(c)) for c in columns})


def leaks(build, bars: DataFrame, since, keys=("symbol", "ts")) -> list[str]:
    """Columns of build(bars) whose rows before `since` change when later bars
    do."""
    a = build(bars).where(F.col("ts") < F.lit(since))
    b = build(tampered(bars, since)).where(F.col("ts") < F.lit(since))
    cols = [c for c in a.columns if c not in keys]
    b = b.select(*keys, *[F.col(c).alias(f"_{c}") for c in cols])

    def differs(c):
        if dict(a.dtypes)[c] in ("double", "float"):
            return ~((F.abs(F.col(c) - F.col(f"_{c}")) <= 1e-7 * F.greatest(F.lit(1.0), F.abs(c))) | (F.col(c).isNull() & F.col(f"_{c}").isNull())) | (F.col(c).isNull() != F.col(f"_{c}").isNull())
        return ~F.col(c).eqNullSafe(F.col(f"_{c}"))

    row = a.join(b, list(keys)).agg(*[F.count_if(F.coalesce(differs(c), F.lit(True))).alias(c) for c in cols]).first()
    return [c for c in cols if row[c]]
