"""Repeat visits and value per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopgrain.functions import channel as ch
from shopgrain.functions.metrics import pct, ratio, tally, total
from shopgrain.functions.timebucket import Span
from shopgrain.operators.grain import priced, with_orders


def _session_type():
    flag = F.col("is_repeat_session")
    return F.when(flag == 0, "New").when(flag == 1, "Repeat")


def visit_buckets(sessions: DataFrame, span: Span = Span.of_year(2014)) -> DataFrame:
    """Users by their number of sessions: 1, 2, 3, 4 or more."""
    n = F.col("total_sessions")
    # Names of the groups.
    name = (
        F.when(n == 1, "1 session")
        .when(n == 2, "2 sessions")
        .when(n == 3, "3 sessions")
        .when(n >= 4, "4+ sessions")
    )
    return (
        sessions.where(span.holds())
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("total_sessions"))
        .groupBy(name.alias("session_bucket"))
        .agg(F.count("user_id").alias("user_count"), F.min("total_sessions").alias("_least"))
        .orderBy("_least")
        .drop("_least")
    )


def days_to_return(sessions: DataFrame, span: Span = Span.of_year(2014)) -> DataFrame:
    """Calendar days from the first to the second session of a user.

    Only dates matter, so sessions are first counted per (user, date). A user then
    brings at most one entry per day of the span, however many sessions there are, and
    the two least are looked at.
    """
    days = (
        sessions.where(span.holds())
        .groupBy("user_id", F.to_date("created_at").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    least = F.slice(F.sort_array(F.collect_list(F.struct("day", "n"))), 1, 2)
    first, next_ = F.get("least", F.lit(0)), F.get("least", F.lit(1))
    gap = F.when(first["n"] > 1, 0).otherwise(F.datediff(next_["day"], first["day"]))
    gaps = (
        days.where(F.col("day").isNotNull())
        .groupBy("user_id")
        .agg(least.alias("least"))
        .select(gap.alias("gap"))
    )
    return gaps.agg(
        F.min("gap").alias("min_days_to_return"),
        F.max("gap").alias("max_days_to_return"),
        ratio(F.sum("gap"), F.count("gap"), 1).alias("avg_days_to_return"),
    )


def channel_mix(sessions: DataFrame, span: Span = Span.of_year(2014)) -> DataFrame:
    """Channels of new and of repeat sessions."""
    counts = [tally(rule).alias(name) for name, rule in ch.five_channels().items()]
    return (
        sessions.where(span.holds() & ch.in_scope())
        .groupBy("is_repeat_session")
        .agg(*counts, F.count(F.lit(1)).alias("total_sessions"))
        .orderBy("is_repeat_session")
        .select(_session_type().alias("session_type"), *ch.five_channels(), "total_sessions")
    )


def conversion(
    sessions: DataFrame, orders: DataFrame, span: Span = Span.of_year(2014)
) -> DataFrame:
    """Conversion and revenue per session, new against repeat sessions."""
    return (
        with_orders(sessions.where(span.holds() & ch.in_scope()), orders)
        .groupBy("is_repeat_session")
        .agg(
            F.count(F.lit(1)).alias("sessions"),
            total("n_orders").alias("orders"),
            F.sum("order_revenue").alias("_revenue"),
        )
        .orderBy("is_repeat_session")
        .select(
            _session_type().alias("session_type"),
            "sessions",
            "orders",
            pct("orders", "sessions").alias("conv_rate_pct"),
            ratio("_revenue", "sessions").alias("rev_per_session_usd"),
        )
    )


def value_per_user(
    sessions: DataFrame, orders: DataFrame, span: Span = Span.of_year(2014)
) -> DataFrame:
    """Sessions, orders and revenue per user, single visit against returned."""
    users = (
        with_orders(sessions.where(span.holds() & ch.in_scope()), orders)
        .groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("n_sessions"),
            total("n_orders").alias("n_orders"),
            F.coalesce(F.sum("order_revenue"), F.lit(0)).alias("revenue"),
        )
    )
    # Names of the groups.
    kind = F.when(F.col("n_sessions") == 1, "Single visit").otherwise("Returned at least once")
    n = F.count(F.lit(1))
    return (
        users.groupBy(kind.alias("user_type"))
        .agg(
            F.count("user_id").alias("users"),
            ratio(F.sum("n_sessions"), n, 1).alias("avg_sessions_per_user"),
            ratio(F.sum("n_orders"), n).alias("avg_orders_per_user"),
            ratio(F.sum("revenue"), n).alias("avg_revenue_per_user"),
        )
        .orderBy(F.desc("user_type"))
    )


def repeat_buyers(orders: DataFrame) -> DataFrame:
    """Users with more than one priced order: orders, margin, first and last order.

    An order counts once, however often its row is there: rows come down to one per
    user and order in fixed-width buffers, then to one per user.
    """
    gain = F.col("price_usd") - F.col("cogs_usd")
    return (
        priced(orders)
        .groupBy("user_id", "order_id")
        .agg(F.min(gain).alias("gain"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))
        .groupBy("user_id")
        .agg(
            F.count("order_id").alias("total_orders"),
            F.sum("gain").alias("lifetime_margin"),
            F.min("first").alias("first_order"),
            F.max("last").alias("last_order"),
        )
        .where(F.col("total_orders") > 1)
    )
