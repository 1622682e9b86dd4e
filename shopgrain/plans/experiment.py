"""Landing page and checkout experiments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopgrain.functions.channel import MAIN_SOURCE, NONBRAND, paid
from shopgrain.functions.metrics import pct, ratio, tally, total
from shopgrain.functions.timebucket import ALWAYS, Span, yearweek
from shopgrain.operators.grain import (
    SESSION,
    entered_on,
    entry_page,
    orders_per_session,
    page_flags,
    page_hits,
    with_orders,
)

# The pages under test.
HOME = "/home"
LANDER = "/lander-1"
BILLING = "/billing"
BILLING_NEW = "/billing-2"

MAIN_CHANNEL = (MAIN_SOURCE, NONBRAND)


def _scope(sessions: DataFrame, span: Span, channel: tuple[str, str] | None) -> DataFrame:
    rule = span.holds()
    if channel is not None:
        rule = rule & paid(*channel)
    return sessions.where(rule)


def entry_pages(sessions: DataFrame, pageviews: DataFrame) -> DataFrame:
    """Sessions per entry page, over all pages."""
    return (
        sessions.select(SESSION)
        .join(entry_page(pageviews), SESSION)
        .groupBy("entry_page")
        .agg(
            F.count(F.lit(1)).alias("sessions"),
            F.sum("n_views").alias("pageviews"),
        )
        .orderBy("entry_page")
    )


def first_seen(
    sessions: DataFrame,
    pageviews: DataFrame,
    page: str = LANDER,
    channel: tuple[str, str] | None = MAIN_CHANNEL,
) -> DataFrame:
    """First time a page was the entry page of a session of the channel."""
    return (
        _scope(sessions, ALWAYS, channel)
        .select(SESSION)
        .join(entered_on(pageviews, [page]), SESSION)
        .agg(F.min("entered_at").alias("first_seen"))
    )


def first_sessions(
    sessions: DataFrame,
    pageviews: DataFrame,
    page: str = LANDER,
    channel: tuple[str, str] | None = MAIN_CHANNEL,
    n: int = 5,
) -> DataFrame:
    """The first n sessions that entered on a page."""
    return (
        _scope(sessions, ALWAYS, channel)
        .join(entered_on(pageviews, [page]), SESSION)
        .select(
            SESSION,
            F.col("created_at").alias("session_start"),
            F.col("entered_at").alias("first_pageview_at"),
            F.col("entry_page").alias("landing_page"),
        )
        .orderBy("first_pageview_at", SESSION)
        .limit(n)
    )


def bounce_rate(
    sessions: DataFrame,
    pageviews: DataFrame,
    pages: Sequence[str] = (HOME, LANDER),
    span: Span = Span.inclusive("2012-06-19", "2012-07-28"),
    channel: tuple[str, str] | None = MAIN_CHANNEL,
) -> DataFrame:
    """Sessions with exactly one page view, per entry page."""
    return (
        _scope(sessions, span, channel)
        .select(SESSION)
        .join(entered_on(pageviews, pages), SESSION)
        .groupBy(F.col("entry_page").alias("landing_page"))
        .agg(
            F.count(F.lit(1)).alias("total_sessions"),
            tally(F.col("n_views") == 1).alias("bounced_sessions"),
        )
        .withColumn("bounce_rate_pct", pct("bounced_sessions", "total_sessions"))
        .orderBy("landing_page")
    )


def weekly_routing(
    sessions: DataFrame,
    pageviews: DataFrame,
    pages: dict[str, str] | None = None,
    span: Span = Span("2012-06-01"),
    channel: tuple[str, str] | None = MAIN_CHANNEL,
) -> DataFrame:
    """Sessions per week and entry page; shows when routing changed.

    ``pages`` maps a column prefix to a page.
    """
    pages = pages or {"home": HOME, "lander1": LANDER}
    counts = [
        tally(F.col("entry_page") == page).alias(f"{name}_sessions")
        for name, page in pages.items()
    ]
    return (
        _scope(sessions, span, channel)
        .select(SESSION, "created_at")
        .join(entered_on(pageviews, list(pages.values())), SESSION)
        .groupBy(yearweek("created_at").alias("yr_wk"))
        .agg(F.min(F.to_date("created_at")).alias("week_start"), *counts)
        .orderBy("yr_wk")
    )


def landing_conversion(
    sessions: DataFrame,
    pageviews: DataFrame,
    orders: DataFrame,
    pages: Sequence[str] = (HOME, LANDER),
    span: Span = Span.inclusive("2012-06-19", "2012-07-28"),
    channel: tuple[str, str] | None = MAIN_CHANNEL,
) -> DataFrame:
    """Conversion per entry page inside the test window."""
    scope = _scope(sessions, span, channel).select(SESSION)
    return (
        with_orders(scope.join(entered_on(pageviews, pages), SESSION), orders)
        .groupBy(F.col("entry_page").alias("landing_page"))
        .agg(F.count(F.lit(1)).alias("sessions"), total("n_orders").alias("orders"))
        .withColumn("conv_rate_pct", pct("orders", "sessions"))
        .orderBy("landing_page")
    )


def after_test(
    sessions: DataFrame,
    pageviews: DataFrame,
    orders: DataFrame,
    page: str = LANDER,
    span: Span = Span("2012-07-28", start_open=True),
    channel: tuple[str, str] | None = MAIN_CHANNEL,
) -> DataFrame:
    """Sessions, orders and order value of the winning page after the test."""
    landed = entered_on(pageviews, [page]).select(SESSION)
    scope = _scope(sessions, span, channel).join(landed, SESSION, "left_semi")
    return (
        with_orders(scope, orders)
        .agg(
            F.count(F.lit(1)).alias("post_test_sessions"),
            total("n_orders").alias("total_orders"),
            F.sum("order_revenue").alias("_revenue"),
        )
        .select(
            "post_test_sessions",
            "total_orders",
            ratio("_revenue", "total_orders").alias("overall_aov"),
        )
    )


def landing_value(test: DataFrame, after: DataFrame, control: str = HOME, variant: str = LANDER) -> DataFrame:
    """Extra revenue since the test: conversion lift x sessions x order value.

    ``test`` is :func:`landing_conversion`, ``after`` is :func:`after_test`.
    """

    def rate(page: str) -> Column:
        return F.max(F.when(F.col("landing_page") == page, F.col("conv_rate_pct")))

    lift = test.agg(rate(control).alias("control_pct"), rate(variant).alias("variant_pct"))
    gain = F.col("variant_pct") - F.col("control_pct")
    later = after.select(F.struct("post_test_sessions", "overall_aov")).scalar()
    return lift.withColumn("_after", later).select(
        "control_pct", "variant_pct", F.round(gain, 2).alias("lift_pp"), "_after.*"
    ).withColumn(
        "incremental_revenue",
        F.round(F.col("lift_pp") / 100 * F.col("post_test_sessions") * F.col("overall_aov"), 2),
    )


def checkout_test(
    sessions: DataFrame,
    pageviews: DataFrame,
    orders: DataFrame,
    pages: Sequence[str] = (BILLING, BILLING_NEW),
    span: Span = Span.inclusive("2012-09-10", "2012-11-10"),
    grain_safe: bool = False,
) -> DataFrame:
    """Conversion and revenue per session for each checkout page.

    As the report was written, an order's revenue counts once per *view* of the
    page; ``grain_safe`` counts it once per session. A session that saw both
    pages belongs to both rows.
    """
    views = F.lit(1) if grain_safe else F.col("n_views")
    hits = page_hits(pageviews, pages).join(sessions.where(span.holds()).select(SESSION), SESSION)
    return (
        hits.join(orders_per_session(orders), SESSION, "left")
        .groupBy(F.col("page").alias("billing_page"))
        .agg(
            F.count(F.lit(1)).alias("billing_sessions"),
            total("n_orders").alias("orders"),
            F.sum(F.col("order_revenue") * views).alias("_revenue"),
        )
        .select(
            "billing_page",
            "billing_sessions",
            "orders",
            pct("orders", "billing_sessions").alias("billing_conv_rate_pct"),
            ratio("_revenue", "billing_sessions").alias("revenue_per_billing_session"),
        )
        .orderBy("billing_page")
    )


def page_sessions(
    sessions: DataFrame,
    pageviews: DataFrame,
    page: str = BILLING_NEW,
    span: Span = Span.of_month(2015, 2),
) -> DataFrame:
    """Sessions of a window that viewed a page."""
    seen = page_hits(pageviews, [page]).select(SESSION)
    return sessions.where(span.holds()).join(seen, SESSION, "left_semi").agg(
        F.count(F.lit(1)).alias("page_sessions")
    )


def checkout_value(
    test: DataFrame, month: DataFrame, control: str = BILLING, variant: str = BILLING_NEW
) -> DataFrame:
    """Monthly value of the winning checkout page: revenue lift x sessions.

    ``test`` is :func:`checkout_test`, ``month`` is :func:`page_sessions`.
    """

    def revenue(page: str) -> Column:
        return F.max(F.when(F.col("billing_page") == page, F.col("revenue_per_billing_session")))

    return (
        test.agg(revenue(control).alias("control_value"), revenue(variant).alias("variant_value"))
        .select(
            "control_value",
            "variant_value",
            F.round(F.col("variant_value") - F.col("control_value"), 2).alias("lift_per_session"),
            month.select("page_sessions").scalar().alias("page_sessions"),
        )
        .withColumn("monthly_value", F.round(F.col("lift_per_session") * F.col("page_sessions"), 2))
    )


def two_arm_test(
    pageviews: DataFrame,
    orders: DataFrame,
    control: str = BILLING,
    variant: str = BILLING_NEW,
) -> DataFrame:
    """Conversion of the sessions of a test by whether they saw the variant (0/1)."""
    arms = page_flags(pageviews, {"control": (control,), "variant": (variant,)})
    return (
        with_orders(arms, orders)
        .groupBy(F.col("hit_variant").alias("saw_variant"))
        .agg(F.count(F.lit(1)).alias("sessions"), total("n_orders").alias("orders"))
        .withColumn("conversion_rate", pct("orders", "sessions"))
        .orderBy("saw_variant")
    )
