"""Facts brought to one row per session, order or item.

All of these are plain hash aggregations with a map-side combine: a key that
holds a large part of the rows arrives at its reducer as one partial row per
map task. Results are unique on their key, so the joins that follow are 1:1.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopgrain.functions.text import url

SESSION = "website_session_id"

# Fixed value: the id of the test artefact among the products.
ORPHAN_PRODUCT = 99


def priced(orders: DataFrame) -> DataFrame:
    """Orders with a positive price.

    Apply it to the right side *before* a left join; as a filter after the join
    it would drop the sessions without an order.
    """
    return orders.where(F.col("price_usd") > 0)


def known_product(orphan: int = ORPHAN_PRODUCT) -> Column:
    """Strict form, for the ON side of a join: a NULL product fails."""
    return F.col("product_id") != orphan


def known_or_no_product(orphan: int = ORPHAN_PRODUCT) -> Column:
    """Form for a filter after a left join: a NULL product passes."""
    return F.col("product_id").isNull() | (F.col("product_id") != orphan)


def session_rows(sessions: DataFrame, *keys: Column) -> DataFrame:
    """One row per session and ``keys``, with ``n_rows``, for tables that hold a session twice.

    Counting its rows counts distinct sessions, without a set per group and without
    ``Expand``; ``n_rows`` times a figure of the session is what its joined rows add up to.
    """
    return sessions.groupBy(SESSION, *keys).agg(F.count(F.lit(1)).alias("n_rows"))


def orders_per_session(orders: DataFrame, repeats: bool = False) -> DataFrame:
    """(session, n_orders, order_revenue) over priced orders.

    With ``repeats`` an order may have several rows: it counts once, its money as often as
    it is there. A session's rows are brought to one per order first, and then counted.
    """
    orders = priced(orders)
    if repeats:
        orders = orders.groupBy(SESSION, "order_id").agg(F.sum("price_usd").alias("price_usd"))
    return orders.groupBy(SESSION).agg(
        F.count("order_id").alias("n_orders"),
        F.sum("price_usd").alias("order_revenue"),
    )


def lines_per_order(items: DataFrame, keep: Column | None = None) -> DataFrame:
    """(order, n_lines, n_kept, item_revenue, item_margin); money over kept lines."""
    keep = known_or_no_product() if keep is None else keep
    return items.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count(F.when(keep, F.lit(1))).alias("n_kept"),
        F.sum(F.when(keep, F.col("price_usd"))).alias("item_revenue"),
        margin(keep).alias("item_margin"),
    )


def margin(keep: Column) -> Column:
    """Sum of price minus cost over kept lines that have both.

    Two sums and one difference per group: a short decimal is summed as a long,
    the difference of two would already be too wide for that.
    """
    both = keep & F.col("price_usd").isNotNull() & F.col("cogs_usd").isNotNull()
    return F.sum(F.when(both, F.col("price_usd"))) - F.sum(F.when(both, F.col("cogs_usd")))


def baskets_per_session(
    orders: DataFrame, items: DataFrame, orphan: int = ORPHAN_PRODUCT, repeats: bool = False
) -> DataFrame:
    """Orders and their lines, one row per session that has a priced order.

    Columns: ``n_priced`` (all priced orders), ``n_orders`` (those that keep at
    least one line or never had one), ``n_items`` and ``item_revenue`` over the
    kept lines. A session with ``n_orders = 0`` had nothing but orphan lines. With
    ``repeats`` an order of several rows counts once and its lines for each of them.
    """
    lines = lines_per_order(items, known_or_no_product(orphan))
    survives = F.col("n_lines").isNull() | (F.col("n_kept") > 0)
    rows, n_items, revenue = priced(orders).select(SESSION, "order_id"), F.col("n_kept"), F.col("item_revenue")
    if repeats:
        rows = session_rows(rows, F.col("order_id"))
        n_items, revenue = n_items * F.col("n_rows"), revenue * F.col("n_rows")
    return (
        rows.join(lines, "order_id", "left")
        .groupBy(SESSION)
        .agg(
            F.count("order_id").alias("n_priced"),
            F.count(F.when(survives, F.lit(1))).alias("n_orders"),
            F.sum(n_items).alias("n_items"),
            F.sum(revenue).alias("item_revenue"),
        )
    )


def with_orders(sessions: DataFrame, orders: DataFrame, repeats: bool = False) -> DataFrame:
    """Every session with its order count and order revenue (NULL without orders)."""
    return sessions.join(orders_per_session(orders, repeats), SESSION, "left")


def with_baskets(
    sessions: DataFrame,
    orders: DataFrame,
    items: DataFrame,
    orphan: int = ORPHAN_PRODUCT,
    repeats: bool = False,
) -> DataFrame:
    """Sessions with line-level revenue.

    The orphan rule is applied *after* the left join: sessions whose only lines
    are orphans leave the report, sessions without orders stay.
    """
    joined = sessions.join(baskets_per_session(orders, items, orphan, repeats), SESSION, "left")
    return joined.where(F.col("n_priced").isNull() | (F.col("n_orders") > 0))


def page_flags(pageviews: DataFrame, steps: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per session with ``hit_<step>`` 0/1 for every step.

    A step is hit if any of its pages was viewed at any time. Views of other
    pages are dropped before the shuffle, so a session without any step page is
    absent.
    """
    page = F.col("_page")
    wanted = sorted({p for pages in steps.values() for p in pages})
    flags = [
        F.max(F.when(page.isin(*pages), 1).otherwise(0)).alias(f"hit_{name}")
        for name, pages in steps.items()
    ]
    views = pageviews.select(SESSION, url().alias("_page"))
    return views.where(page.isin(*wanted)).groupBy(SESSION).agg(*flags)


def page_hits(pageviews: DataFrame, pages: Sequence[str]) -> DataFrame:
    """(session, page, n_views) for the given pages."""
    return (
        pageviews.select(SESSION, url().alias("page"))
        .where(F.col("page").isin(*pages))
        .groupBy(SESSION, "page")
        .agg(F.count(F.lit(1)).alias("n_views"))
    )


def entry_page(pageviews: DataFrame) -> DataFrame:
    """Entry page of every session: the page of its lowest page view id."""
    return pageviews.groupBy(SESSION).agg(
        F.min_by(url(), "website_pageview_id").alias("entry_page"),
        F.min_by("created_at", "website_pageview_id").alias("entered_at"),
        F.count(F.lit(1)).alias("n_views"),
    )


def entered_on(pageviews: DataFrame, pages: Sequence[str]) -> DataFrame:
    """Sessions that entered on one of the given pages.

    Same columns as :func:`entry_page`. Knowing the pages, the entry page is the
    one whose own lowest id equals the session's lowest id. That keeps all
    buffers fixed-width, so Spark hashes instead of sorting every page view.
    """
    page, view = F.col("_page"), F.col("website_pageview_id")
    firsts = [
        F.min(F.when(page == name, view)).alias(f"_first_{i}") for i, name in enumerate(pages)
    ]
    seen = pageviews.withColumn("_page", url()).groupBy(SESSION).agg(
        F.min(view).alias("_first"),
        F.min_by("created_at", "website_pageview_id").alias("entered_at"),
        F.count(F.lit(1)).alias("n_views"),
        *firsts,
    )
    entry = None
    for i, name in enumerate(pages):
        rule = F.col(f"_first_{i}") == F.col("_first")
        entry = F.when(rule, name) if entry is None else entry.when(rule, name)
    return seen.select(SESSION, entry.alias("entry_page"), "entered_at", "n_views").where(
        F.col("entry_page").isNotNull()
    )


def refunds_per_item(refunds: DataFrame) -> DataFrame:
    return refunds.groupBy("order_item_id").agg(F.count(F.lit(1)).alias("n_refunds"))
