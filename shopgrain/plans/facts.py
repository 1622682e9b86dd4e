"""A stored table of session facts, refreshed by month and read by the KPI reports.

``refresh`` brings baskets, order totals and funnel steps to one row per session once, and
writes the months it is given over what they had; other months stay as they are. The
reports below then are one scan with a filter on months and one grouping: no join, no
exchange of sessions. They equal the reports of ``growth``, ``channels`` and ``funnel`` on
the tables the facts were made from.

A session belongs to the month it began in, and so do its orders and page views, whenever
they came: a month is refreshed again when later orders of its sessions arrive. Sessions
without a time form a month of their own, which only a refresh of all months writes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopgrain.functions.channel import in_scope
from shopgrain.functions.timebucket import ALWAYS, Span, bucket
from shopgrain.operators.grain import ORPHAN_PRODUCT, SESSION, baskets_per_session, orders_per_session, page_flags
from shopgrain.plans import channels, funnel, growth
from shopgrain.sources.tables import Shop

_KEPT = (SESSION, "created_at", "user_id", "is_repeat_session", "utm_source", "utm_campaign", "device_type", "http_referer")


def _month() -> Column:
    return (F.year("created_at") * 100 + F.month("created_at")).cast("int")


def session_facts(
    sessions: DataFrame, shop: Shop, detail_pages: Sequence[str], orphan: int = ORPHAN_PRODUCT
) -> DataFrame:
    """One row for each of ``sessions``; figures are NULL where a session has none."""
    orders = orders_per_session(shop.orders).withColumnsRenamed({"n_orders": "n_all_orders"})
    return (
        sessions.select(*_KEPT, _month().alias("month"))
        .join(orders, SESSION, "left")
        .join(baskets_per_session(shop.orders, shop.order_items, orphan), SESSION, "left")
        .join(page_flags(shop.pageviews, funnel.steps(detail_pages)), SESSION, "left")
    )


def refresh(
    shop: Shop,
    folder: str,
    detail_pages: Sequence[str],
    months: Sequence[tuple[int, int]] | None = None,
    orphan: int = ORPHAN_PRODUCT,
) -> None:
    """Writes the facts of the given (year, month)s, or of all, over those months.

    A month that has no session any more keeps its old rows, unless all are written.
    """
    scope = shop.sessions
    if months is not None:
        # As windows of time, so that they reach the scan of the sessions.
        rule = F.lit(False)
        for year, month in months:
            rule = rule | Span.of_month(year, month).holds()
        scope = scope.where(rule)
    facts = session_facts(scope, shop, detail_pages, orphan).hint("rebalance", "month")
    mode = "static" if months is None else "dynamic"
    facts.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("month").parquet(folder)


def open_facts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def _within(facts: DataFrame, span: Span) -> DataFrame:
    """Sessions of the window; whole months outside it are not read."""
    rule = span.holds()
    for bound, low in ((span.start, True), (span.end, False)):
        if bound is not None:
            month = int(bound[:4]) * 100 + int(bound[5:7])
            rule = rule & (F.col("month") >= month if low else F.col("month") <= month)
    return facts.where(rule)


def _with_baskets(facts: DataFrame, span: Span) -> DataFrame:
    """As ``grain.with_baskets``: sessions with nothing but orphan lines leave the report."""
    kept = F.col("n_priced").isNull() | (F.col("n_orders") > 0)
    return _within(facts, span).where(in_scope() & kept)


def master_kpis(facts: DataFrame, by: str = "quarter", span: Span = ALWAYS) -> DataFrame:
    return growth.kpi_table(growth.line_figures(_with_baskets(facts, span), bucket(by)), by)


def quarterly_channels(facts: DataFrame, span: Span = ALWAYS) -> DataFrame:
    return channels.channel_figures(_with_baskets(facts, span))


def site_funnel(
    facts: DataFrame, detail_pages: Sequence[str], span: Span = Span.of_year(2014), by: str | None = None
) -> DataFrame:
    visits = _within(facts, span).where(in_scope())
    return funnel.reached(visits, list(funnel.steps(detail_pages)), by)
