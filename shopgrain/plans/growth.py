"""Sessions, orders and revenue over time.

Tables keep the load rule, so rows are counted. With ``repeats`` they may hold rows twice:
sessions and orders count once by their ids, and money adds up over the joined rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopgrain.functions.channel import MAIN_SOURCE, NONBRAND, campaign_is, in_scope, six_channels
from shopgrain.functions.channel import BRAND, device_is, paid, source_is
from shopgrain.functions.metrics import money, pct, ratio, total
from shopgrain.functions.timebucket import ALWAYS, BUCKETS, Span, bucket
from shopgrain.operators.grain import (
    ORPHAN_PRODUCT,
    SESSION,
    session_rows,
    with_baskets,
    with_orders,
)

# Quarters the data covers only in part.
PARTIAL_QUARTERS = ((2012, 1), (2015, 1))


def order_kpis(
    sessions: DataFrame,
    orders: DataFrame,
    by: str = "quarter",
    where: Column | None = None,
    repeats: bool = False,
) -> DataFrame:
    """All order-level figures per time bucket; reports select from it.

    Catalyst prunes the figures a report does not select. Revenue is NULL, not
    0, in a bucket without orders.
    """
    scope = sessions if where is None else sessions.where(where)
    keys = BUCKETS[by]
    buckets, revenue = bucket(by), F.col("order_revenue")
    if repeats:
        scope, buckets = session_rows(scope, *buckets), keys
        revenue = revenue * F.col("n_rows")
    return (
        with_orders(scope, orders, repeats)
        .groupBy(*buckets)
        .agg(
            F.count(F.lit(1)).alias("sessions"),
            total("n_orders").alias("orders"),
            F.sum(revenue).alias("_revenue"),
        )
        .select(
            *keys,
            "sessions",
            "orders",
            money("_revenue").alias("total_revenue"),
            pct("orders", "sessions").alias("conv_rate_pct"),
            ratio("_revenue", "orders").alias("avg_order_value"),
            ratio("_revenue", "sessions").alias("rev_per_session"),
        )
    )


def basket_kpis(
    sessions: DataFrame,
    orders: DataFrame,
    items: DataFrame,
    keys: Sequence[Column],
    where: Column | None = None,
    orphan: int = ORPHAN_PRODUCT,
    repeats: bool = False,
) -> DataFrame:
    """All line-level figures per group of sessions; reports select from it."""
    scope = sessions if where is None else sessions.where(where)
    n_items, revenue = "n_items", F.col("item_revenue")
    if repeats:
        scope = session_rows(scope, *keys)
        keys = [F.col(f"`{c}`") for c in scope.columns if c not in (SESSION, "n_rows")]
        n_items, revenue = F.col("n_items") * F.col("n_rows"), revenue * F.col("n_rows")
    return line_figures(with_baskets(scope, orders, items, orphan, repeats), keys, n_items, revenue)


def line_figures(
    visits: DataFrame, keys: Sequence[Column], n_items: str | Column = "n_items", revenue: str | Column = "item_revenue"
) -> DataFrame:
    """The figures of :func:`basket_kpis` from sessions with their baskets."""
    grouped = visits.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sessions"),
        total("n_orders").alias("orders"),
        total(n_items).alias("_items"),
        F.sum(revenue).alias("_revenue"),
    )
    names = [c for c in grouped.columns if c not in ("sessions", "orders", "_items", "_revenue")]
    return grouped.select(
        *names,
        "sessions",
        "orders",
        pct("orders", "sessions").alias("conv_rate_pct"),
        ratio("_revenue", "orders").alias("avg_order_value"),
        ratio("_items", "orders").alias("products_per_order"),
        ratio("_revenue", "sessions").alias("rev_per_session"),
        money("_revenue").alias("total_revenue"),
    )


def split_counts(
    sessions: DataFrame,
    orders: DataFrame,
    groups: Mapping[str, Column],
    by: str = "month",
    where: Column | None = None,
    repeats: bool = False,
) -> DataFrame:
    """``<group>_sessions`` and ``<group>_orders`` side by side per bucket.

    At session grain the distinct counts of every group are plain sums, so the
    rows are not expanded once per group.
    """
    scope = sessions if where is None else sessions.where(where)
    buckets = bucket(by)
    if repeats:
        # Per session and bucket, whether any of its rows is in the group.
        buckets = BUCKETS[by]
        seen = [F.max(F.when(rule, 1).otherwise(0)).alias(f"_in_{i}") for i, rule in enumerate(groups.values())]
        scope = scope.groupBy(SESSION, *bucket(by)).agg(*seen)
        groups = {name: F.col(f"_in_{i}") == 1 for i, name in enumerate(groups)}
    columns = []
    for name, rule in groups.items():
        columns.append(F.count(F.when(rule, F.lit(1))).alias(f"{name}_sessions"))
        columns.append(total("n_orders", rule).alias(f"{name}_orders"))
    return (
        with_orders(scope, orders, repeats).groupBy(*buckets).agg(*columns).orderBy(*BUCKETS[by])
    )


def quarterly_growth(
    sessions: DataFrame,
    orders: DataFrame,
    partial: Sequence[tuple[int, int]] = PARTIAL_QUARTERS,
    where: Column | None = None,
    repeats: bool = False,
) -> DataFrame:
    """Sessions and orders per quarter, with a label for partly covered quarters."""
    edge = F.lit(False)
    for year, quarter in partial:
        edge = edge | ((F.col("yr") == year) & (F.col("qtr") == quarter))
    return (
        order_kpis(sessions, orders, "quarter", where, repeats)
        .select(
            "yr",
            "qtr",
            "sessions",
            "orders",
            F.when(edge, "Partial").otherwise("Complete").alias("quarter_status"),
        )
        .orderBy("yr", "qtr")
    )


def channel_growth(
    sessions: DataFrame,
    orders: DataFrame,
    source: str = MAIN_SOURCE,
    campaign: str = NONBRAND,
    repeats: bool = False,
) -> DataFrame:
    """Monthly sessions and orders of one channel."""
    return (
        order_kpis(sessions, orders, "month", paid(source, campaign), repeats)
        .select("yr", "mo", "sessions", "orders")
        .orderBy("yr", "mo")
    )


def campaign_split(
    sessions: DataFrame, orders: DataFrame, source: str = MAIN_SOURCE, repeats: bool = False
) -> DataFrame:
    """Monthly nonbrand against brand traffic of one source."""
    groups = {NONBRAND: campaign_is(NONBRAND), BRAND: campaign_is(BRAND)}
    scope = source_is(source) & campaign_is(NONBRAND, BRAND)
    return split_counts(sessions, orders, groups, "month", scope, repeats)


def device_split(
    sessions: DataFrame,
    orders: DataFrame,
    source: str = MAIN_SOURCE,
    campaign: str = NONBRAND,
    devices: Sequence[str] = ("desktop", "mobile"),
    repeats: bool = False,
) -> DataFrame:
    """Monthly traffic of one channel by device."""
    groups = {name: device_is(name) for name in devices}
    return split_counts(sessions, orders, groups, "month", paid(source, campaign), repeats)


def channel_split(
    sessions: DataFrame,
    orders: DataFrame,
    channels: Mapping[str, Column] | None = None,
    repeats: bool = False,
) -> DataFrame:
    """Monthly sessions and orders of every channel side by side."""
    return split_counts(sessions, orders, channels or six_channels(), "month", repeats=repeats)


def conversion_rate(
    sessions: DataFrame, orders: DataFrame, by: str = "quarter", repeats: bool = False
) -> DataFrame:
    keys = BUCKETS[by]
    return (
        order_kpis(sessions, orders, by, repeats=repeats)
        .select(*keys, "sessions", "orders", "conv_rate_pct")
        .orderBy(*keys)
    )


def average_order_value(
    sessions: DataFrame, orders: DataFrame, by: str = "quarter", repeats: bool = False
) -> DataFrame:
    keys = BUCKETS[by]
    return (
        order_kpis(sessions, orders, by, repeats=repeats)
        .select(*keys, "orders", "total_revenue", "avg_order_value")
        .orderBy(*keys)
    )


def revenue_per_session(
    sessions: DataFrame, orders: DataFrame, by: str = "quarter", repeats: bool = False
) -> DataFrame:
    keys = BUCKETS[by]
    return (
        order_kpis(sessions, orders, by, repeats=repeats)
        .select(*keys, "sessions", "total_revenue", "rev_per_session")
        .orderBy(*keys)
    )


def master_kpis(
    sessions: DataFrame,
    orders: DataFrame,
    items: DataFrame,
    by: str = "quarter",
    span: Span = ALWAYS,
    orphan: int = ORPHAN_PRODUCT,
    repeats: bool = False,
) -> DataFrame:
    """Line-level KPI table per quarter, or per month of a window as a baseline."""
    scope = in_scope() & span.holds()
    return kpi_table(basket_kpis(sessions, orders, items, bucket(by), scope, orphan, repeats), by)


def kpi_table(figures: DataFrame, by: str) -> DataFrame:
    """The columns of the master table, in its order."""
    keys = BUCKETS[by]
    return figures.select(
        *keys, "sessions", "orders", "conv_rate_pct", "avg_order_value", "rev_per_session", "total_revenue"
    ).orderBy(*keys)


def overall_order_value(sessions: DataFrame, orders: DataFrame, span: Span = ALWAYS) -> DataFrame:
    """One row: order value over all priced orders of the sessions of a window."""
    return (
        with_orders(sessions.where(span.holds()), orders)
        .agg(total("n_orders").alias("orders"), F.sum("order_revenue").alias("_revenue"))
        .select("orders", ratio("_revenue", "orders").alias("avg_order_value"))
    )
