"""Time buckets and date windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bucket name -> key columns it produces.
BUCKETS = {"month": ("yr", "mo"), "quarter": ("yr", "qtr")}


def moment(text: str) -> Column:
    """Timestamp literal without time zone; a bare date means its midnight."""
    return F.lit(text).cast("timestamp_ntz")


def bucket(kind: str, ts: str = "created_at") -> list[Column]:
    """Grouping columns of a month or quarter bucket."""
    if kind not in BUCKETS:
        raise ValueError(f"unknown bucket {kind!r}; use one of {sorted(BUCKETS)}")
    part = F.month(ts).alias("mo") if kind == "month" else F.quarter(ts).alias("qtr")
    return [F.year(ts).alias("yr"), part]


def yearweek(ts: str | Column = "created_at") -> Column:
    """Week number yyyyww; weeks start on Sunday, week 1 holds the year's first Sunday.

    Days before the first Sunday belong to the last week of the year before.
    """
    day = F.to_date(ts)
    sunday = F.date_sub(day, F.dayofweek(day) - 1)
    week = F.floor((F.dayofyear(sunday) - 1) / 7).cast("int") + 1
    return F.year(sunday) * 100 + week


@dataclass(frozen=True)
class Span:
    """A date window over a timestamp column.

    Bounds are text; a bare date is midnight, so a closed end stops at 00:00:00.
    The default is the half-open form, which is the safe one.
    """

    start: str | None = None
    end: str | None = None
    start_open: bool = False
    end_closed: bool = False

    def holds(self, ts: str = "created_at") -> Column:
        rule = F.lit(True)
        if self.start is not None:
            low = moment(self.start)
            rule = rule & ((F.col(ts) > low) if self.start_open else (F.col(ts) >= low))
        if self.end is not None:
            high = moment(self.end)
            rule = rule & ((F.col(ts) <= high) if self.end_closed else (F.col(ts) < high))
        return rule

    @staticmethod
    def inclusive(start: str, end: str) -> Span:
        return Span(start, end, end_closed=True)

    @staticmethod
    def of_year(year: int) -> Span:
        return Span(f"{year}-01-01", f"{year + 1}-01-01")

    @staticmethod
    def of_month(year: int, month: int) -> Span:
        nxt = (year + 1, 1) if month == 12 else (year, month + 1)
        return Span(f"{year}-{month:02d}-01", f"{nxt[0]}-{nxt[1]:02d}-01")


ALWAYS = Span()


def period(spans: dict[str, Span], ts: str = "created_at") -> Column:
    """Name of the first window that holds the timestamp, NULL when none does."""
    result = None
    for name, span in spans.items():
        rule = span.holds(ts)
        result = F.when(rule, name) if result is None else result.when(rule, name)
    return result
