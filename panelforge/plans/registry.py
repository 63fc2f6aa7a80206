"""Every query of the library by name, with its DuckDB SQL where there is one."""

from __future__ import annotations

from panelforge.plans import daily, intraday, modelling, more, relational, research, windows
from panelforge.plans.sql import exact

MODULES = (windows, daily, intraday, relational, research, modelling, more)


def _all() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def queries() -> dict:
    return {k: v[0] for k, v in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: exact(v[1]) for k, v in _all().items() if v[1]}


def flagship(spark, sf_dir: str):
    return windows.w02_rolling(spark, sf_dir)
