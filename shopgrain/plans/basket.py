"""Cross-sell: feature launch, attachment matrix, basket values."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopgrain.functions.metrics import pct, ratio, total
from shopgrain.functions.timebucket import Span, moment, period
from shopgrain.operators.basket import order_products, pairings, primaries
from shopgrain.operators.grain import (
    ORPHAN_PRODUCT,
    SESSION,
    known_product,
    lines_per_order,
    page_hits,
    priced,
)


def feature_launch(
    sessions: DataFrame,
    pageviews: DataFrame,
    orders: DataFrame,
    items: DataFrame,
    periods: Mapping[str, Span] | None = None,
    page: str = "/cart",
    grain_safe: bool = False,
    orphan: int = ORPHAN_PRODUCT,
) -> DataFrame:
    """Cart sessions, conversion, basket size and value per period.

    The default windows end at midnight of their last day, so that day is
    almost empty. As the report was written, lines count once per view of the
    cart page; ``grain_safe`` counts them once. Orphan lines are left out but
    their orders stay.
    """
    periods = periods or {
        "before": Span.inclusive("2013-08-25", "2013-09-24"),
        "after": Span.inclusive("2013-09-25", "2013-10-24"),
    }
    carts = (
        sessions.select(SESSION, period(dict(periods)).alias("period"))
        .where(F.col("period").isNotNull())
        .join(page_hits(pageviews, [page]).select(SESSION, "n_views"), SESSION)
    )
    bought = (
        priced(orders)
        .select(SESSION, "order_id")
        .join(lines_per_order(items, known_product(orphan)), "order_id", "left")
        .groupBy(SESSION)
        .agg(
            F.count("order_id").alias("n_orders"),
            F.sum("n_kept").alias("n_items"),
            F.sum("item_revenue").alias("revenue"),
        )
    )
    views = F.lit(1) if grain_safe else F.col("n_views")
    return (
        carts.join(bought, SESSION, "left")
        .groupBy("period")
        .agg(
            F.count(F.lit(1)).alias("cart_sessions"),
            total("n_orders").alias("orders"),
            total(F.col("n_items") * views).alias("_items"),
            F.sum(F.col("revenue") * views).alias("_revenue"),
        )
        .select(
            "period",
            "cart_sessions",
            "orders",
            pct("orders", "cart_sessions").alias("cart_to_order_ctr_pct"),
            ratio("_items", "orders").alias("avg_products_per_order"),
            ratio("_revenue", "orders").alias("aov_usd"),
            ratio("_revenue", "cart_sessions").alias("rev_per_cart_session_usd"),
        )
        .orderBy(F.desc("period"))
    )


def _scope(orders: DataFrame, span: Span) -> DataFrame:
    return priced(orders).where(span.holds())


def attachment_matrix(
    orders: DataFrame,
    items: DataFrame,
    span: Span = Span("2014-12-05", start_open=True),
    orphan: int = ORPHAN_PRODUCT,
) -> DataFrame:
    """Orders that add a product to a primary product, against all primary orders."""
    products = order_products(items, orphan)
    mains = primaries(_scope(orders, span), products)
    n_orders = F.count(F.lit(1))
    totals = mains.groupBy("primary_product_id").agg(n_orders.alias("total_primary_orders"))
    pairs = (
        pairings(mains, products)
        .groupBy("primary_product_id", "crosssell_product_id")
        .agg(n_orders.alias("orders_with_pairing"))
    )
    return (
        pairs.join(totals, "primary_product_id")
        .select(
            "primary_product_id",
            "crosssell_product_id",
            "orders_with_pairing",
            "total_primary_orders",
            pct("orders_with_pairing", "total_primary_orders").alias("attachment_rate_pct"),
        )
        .orderBy("primary_product_id", F.desc("attachment_rate_pct"), "crosssell_product_id")
    )


def basket_values(
    orders: DataFrame,
    items: DataFrame,
    span: Span = Span("2014-12-05", start_open=True),
    grain_safe: bool = False,
    orphan: int = ORPHAN_PRODUCT,
) -> DataFrame:
    """Average value of the whole order for every pairing.

    As the report was written, an order's value counts once per pair of a
    primary line and an add-on line; ``grain_safe`` counts it once.
    """
    copies = F.lit(1) if grain_safe else F.col("n_main") * F.col("n_extra")
    products = order_products(items, orphan)
    baskets = products.groupBy("order_id").agg(F.sum("revenue").alias("basket"))
    return (
        pairings(primaries(_scope(orders, span), products), products)
        .join(baskets, "order_id")
        .groupBy("primary_product_id", "crosssell_product_id")
        .agg(
            F.count(F.lit(1)).alias("orders_with_pairing"),
            F.sum(F.col("basket") * copies).alias("_value"),
        )
        .select(
            "primary_product_id",
            "crosssell_product_id",
            "orders_with_pairing",
            ratio("_value", "orders_with_pairing").alias("avg_basket_value_usd"),
        )
        .orderBy(F.desc("avg_basket_value_usd"), "primary_product_id", "crosssell_product_id")
    )


def pairing_totals(values: DataFrame) -> DataFrame:
    """Revenue of every pairing, from :func:`basket_values`."""
    worth = F.col("orders_with_pairing") * F.col("avg_basket_value_usd")
    return values.withColumn("total_value_usd", F.round(worth, 2)).orderBy(
        F.desc("total_value_usd"), "primary_product_id", "crosssell_product_id"
    )


def attach_rate(
    items: DataFrame,
    addon: int = 4,
    since: str = "2014-02-12",
    orphan: int = ORPHAN_PRODUCT,
    addons_only: bool = False,
) -> DataFrame:
    """How often orders of each primary product also hold one given product.

    Primary products without a single hit stay in the list. As the report was
    written, the product also counts where it is itself the primary line;
    ``addons_only`` asks for a line that is not primary.
    """
    mains = (
        items.where(
            (F.col("is_primary_item") == 1)
            & known_product(orphan)
            & (F.col("created_at") >= moment(since))
        )
        .select("order_id", F.col("product_id").alias("primary_product"))
        .distinct()
    )
    rule = (F.col("product_id") == addon) & known_product(orphan)
    if addons_only:
        rule = rule & (F.col("is_primary_item") == 0)
    hits = items.where(rule).select("order_id").distinct().withColumn("hit", F.lit(1))
    return (
        mains.join(hits, "order_id", "left")
        .groupBy("primary_product")
        .agg(
            F.count(F.lit(1)).alias("primary_orders"),
            F.count("hit").alias("xsell_orders"),
        )
        .withColumn("attach_rate", pct("xsell_orders", "primary_orders"))
        .orderBy("primary_product")
    )
