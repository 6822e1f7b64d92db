"""Indicator formulas over a row of measures. Empty denominators give 0 here.

Formulas are SQL expressions: one parsed string costs the driver a single call where the
same tree of Column objects costs dozens, which dominates a warm query's latency.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(prefix: str, name: str) -> str:
    return f"CAST({prefix}{name} AS DOUBLE)"


def _or_zero(condition: str, value: str) -> str:
    return f"CASE WHEN {condition} THEN {value} ELSE 0D END"


def _clamped(error: str) -> str:
    return f"greatest(0D, least(100D, (1 - {error}) * 100))"


def conformity_rate_sql(prefix: str = "") -> str:
    rows, off = _d(prefix, "row_count"), _d(prefix, "variance_row_count")
    return _or_zero(f"{rows} > 0", f"({rows} - {off}) / {rows} * 100")


def global_pct_sql(prefix: str = "") -> str:
    expected = _d(prefix, "expected_qty")
    return _or_zero(f"{expected} != 0", f"{_d(prefix, 'variance_qty')} / {expected} * 100")


def reliability_value_sql(prefix: str = "") -> str:
    base = _d(prefix, "expected_value")
    return _or_zero(f"{base} > 0", _clamped(f"{_d(prefix, 'abs_value')} / {base}"))


def reliability_qty_sql(prefix: str = "") -> str:
    base = _d(prefix, "expected_qty")
    error = f"({_d(prefix, 'under_qty')} + {_d(prefix, 'over_qty')}) / {base}"
    return _or_zero(f"{base} > 0", _clamped(error))


def variation_sql(current: str, previous: str) -> tuple[str, str]:
    change = f"(({current}) - ({previous}))"
    return f"CASE WHEN ({previous}) != 0 THEN {change} / abs({previous}) * 100 END", change


def conformity_rate() -> Column:
    """Share of rows within tolerance, in percent."""
    return F.expr(conformity_rate_sql())


def global_pct() -> Column:
    """Net variance over expected quantity, in percent."""
    return F.expr(global_pct_sql())


def reliability_value() -> Column:
    """1 − Σ|variance value| / expected value, clamped to 0..100."""
    return F.expr(reliability_value_sql())


def reliability_qty() -> Column:
    """The same index in units: under and over are both absolute volumes."""
    return F.expr(reliability_qty_sql())


def variation(current: Column, previous: Column) -> tuple[Column, Column]:
    """(change in % of the absolute base, absolute change); the % is NULL on a zero base."""
    change = current - previous
    return F.when(previous != 0, change / F.abs(previous) * 100), change
