"""Guarded, rounded ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def over(n: str | Column, d: str | Column) -> Column:
    """n / d as a double, NULL when d is 0."""
    if isinstance(n, str) and isinstance(d, str):
        # Column names: one parsed expression builds faster than a chain of calls.
        return F.expr(f"cast(`{n}` as double) / nullif(cast(`{d}` as double), 0D)")
    return _col(n).cast("double") / F.nullif(_col(d).cast("double"), F.lit(0.0))


# A quotient that is a tie in decimals may come out a hair below it as a double; nine
# digits bring the tie back, so that halves round up.
_TIE_DIGITS = 9


def ratio(n: str | Column, d: str | Column, digits: int = 2) -> Column:
    return F.round(F.round(over(n, d), _TIE_DIGITS), digits)


def pct(n: str | Column, d: str | Column, digits: int = 2) -> Column:
    """Percentage: multiplied before the division, so one rounding decides."""
    if isinstance(n, str) and isinstance(d, str):
        share = f"cast(`{n}` as double) * 100D / nullif(cast(`{d}` as double), 0D)"
        return F.expr(f"round(round({share}, {_TIE_DIGITS}), {digits})")
    share = _col(n).cast("double") * 100.0 / F.nullif(_col(d).cast("double"), F.lit(0.0))
    return F.round(F.round(share, _TIE_DIGITS), digits)


def tally(rule: Column) -> Column:
    """Number of rows where the rule is true; 0 for no rows."""
    return F.count(F.when(rule, F.lit(1)))


def total(value: str | Column, rule: Column | None = None) -> Column:
    """Sum of a count column, 0 where it is missing (the side of a left join)."""
    if isinstance(value, str) and rule is None:
        return F.expr(f"coalesce(sum(coalesce(`{value}`, 0)), 0)")
    value = F.coalesce(_col(value), F.lit(0))
    if rule is not None:
        value = F.when(rule, value)
    return F.coalesce(F.sum(value), F.lit(0))


def money(value: str | Column) -> Column:
    return F.round(_col(value), 2)
