"""Channel mix and dependence on paid search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopgrain.functions import channel as ch
from shopgrain.functions.metrics import money, pct, tally, total
from shopgrain.functions.text import tag
from shopgrain.functions.timebucket import ALWAYS, Span, bucket, yearweek
from shopgrain.operators.grain import ORPHAN_PRODUCT, with_baskets, with_orders
from shopgrain.plans.growth import master_kpis


def monthly_mix(sessions: DataFrame) -> DataFrame:
    """Sessions per channel and month; free and brand traffic against main paid traffic."""
    rules = ch.five_channels()
    names = {
        "gsearch_nonbrand": "gsearch_nonbrand",
        "bsearch_nonbrand": "bsearch_nonbrand",
        "paid_brand": "paid_brand",
        "organic_search": "organic",
        "direct_typein": "direct",
    }
    counts = [tally(rules[rule]).alias(name) for name, rule in names.items()]
    free = F.col("paid_brand") + F.col("organic_search") + F.col("direct_typein")
    return (
        sessions.where(ch.in_scope())
        .groupBy(*bucket("month"))
        .agg(*counts, F.count(F.lit(1)).alias("total_sessions"))
        .withColumn("free_brand_pct_of_nonbrand", pct(free, "gsearch_nonbrand", 1))
        .orderBy("yr", "mo")
    )


def quarterly_order_mix(sessions: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders per channel and quarter with two headline shares."""
    rules = ch.five_channels()
    free = F.col("organic_orders") + F.col("direct_orders") + F.col("brand_orders")
    return (
        with_orders(sessions.where(ch.in_scope()), orders)
        .groupBy(*bucket("quarter"))
        .agg(
            total("n_orders").alias("total_orders"),
            total("n_orders", rules["gsearch_nonbrand"]).alias("gsearch_nb_orders"),
            total("n_orders", rules["bsearch_nonbrand"]).alias("bsearch_nb_orders"),
            total("n_orders", rules["paid_brand"]).alias("brand_orders"),
            total("n_orders", rules["organic"]).alias("organic_orders"),
            total("n_orders", rules["direct"]).alias("direct_orders"),
        )
        .withColumn("gsearch_nb_pct", pct("gsearch_nb_orders", "total_orders", 1))
        .withColumn("free_and_brand_pct", pct(free, "total_orders", 1))
        .orderBy("yr", "qtr")
    )


def source_by_device(
    sessions: DataFrame,
    orders: DataFrame,
    sources: Sequence[str] = (ch.MAIN_SOURCE, ch.SECOND_SOURCE),
    campaign: str = ch.NONBRAND,
) -> DataFrame:
    """Conversion of each paid source on each device."""
    scope = sessions.where(ch.campaign_is(campaign) & ch.source_is(*sources))
    return (
        with_orders(scope, orders)
        .groupBy(tag("utm_source").alias("channel"), tag("device_type").alias("device"))
        .agg(F.count(F.lit(1)).alias("sessions"), total("n_orders").alias("orders"))
        .withColumn("conv_rate_pct", pct("orders", "sessions"))
        .orderBy("channel", "device")
    )


def weekly_volume(
    sessions: DataFrame,
    span: Span = Span("2012-08-22"),
    sources: Sequence[str] = (ch.MAIN_SOURCE, ch.SECOND_SOURCE),
    campaign: str = ch.NONBRAND,
) -> DataFrame:
    """Weekly sessions of the paid sources; ``week_start`` is the first date seen."""
    counts = [tally(ch.source_is(s)).alias(f"{s}_sessions") for s in sources]
    return (
        sessions.where(span.holds() & ch.campaign_is(campaign) & ch.source_is(*sources))
        .groupBy(yearweek().alias("_week"))
        .agg(F.min(F.to_date("created_at")).alias("week_start"), *counts)
        .drop("_week")
        .orderBy("week_start")
    )


def resilience(sessions: DataFrame, span: Span = Span.of_year(2014)) -> DataFrame:
    """Share of sessions that would come without paid nonbrand search."""
    return (
        sessions.where(span.holds() & ch.in_scope())
        .agg(
            F.count(F.lit(1)).alias("total_sessions"),
            tally(ch.unpaid_or_brand()).alias("free_and_brand_sessions"),
        )
        .withColumn(
            "resilience_score_pct", pct("free_and_brand_sessions", "total_sessions", 1)
        )
    )


def quarterly_channels(
    sessions: DataFrame,
    orders: DataFrame,
    items: DataFrame,
    span: Span = ALWAYS,
    orphan: int = ORPHAN_PRODUCT,
) -> DataFrame:
    """Sessions, orders and revenue, one row per quarter and channel."""
    scope = sessions.where(ch.in_scope() & span.holds())
    return channel_figures(with_baskets(scope, orders, items, orphan))


def channel_figures(visits: DataFrame) -> DataFrame:
    """The figures of :func:`quarterly_channels` from sessions with their baskets."""
    return (
        visits.groupBy(*bucket("quarter"), ch.label().alias("channel"))
        .agg(
            F.count(F.lit(1)).alias("sessions"),
            total("n_orders").alias("orders"),
            money(F.sum("item_revenue")).alias("revenue"),
        )
        .orderBy("yr", "qtr", "channel")
    )


def reconcile_channels(sessions: DataFrame, orders: DataFrame, items: DataFrame) -> DataFrame:
    """Channel figures added up again against the master table, per quarter."""
    parts = (
        quarterly_channels(sessions, orders, items)
        .groupBy("yr", "qtr")
        .agg(
            F.sum("sessions").alias("channel_sessions"),
            F.sum("orders").alias("channel_orders"),
        )
    )
    return (
        master_kpis(sessions, orders, items)
        .select("yr", "qtr", "sessions", "orders")
        .join(parts, ["yr", "qtr"], "left")
        .withColumn(
            "matches",
            (F.col("sessions") == F.col("channel_sessions"))
            & (F.col("orders") == F.col("channel_orders")),
        )
        .orderBy("yr", "qtr")
    )
