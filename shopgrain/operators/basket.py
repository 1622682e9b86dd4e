"""What is bought together, without pairing the lines of an order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopgrain.operators.grain import ORPHAN_PRODUCT, known_product


def order_products(items: DataFrame, orphan: int = ORPHAN_PRODUCT) -> DataFrame:
    """One row per (order, product): primary lines, add-on lines, revenue."""
    return items.where(known_product(orphan)).groupBy("order_id", "product_id").agg(
        F.count(F.when(F.col("is_primary_item") == 1, F.lit(1))).alias("n_main"),
        F.count(F.when(F.col("is_primary_item") == 0, F.lit(1))).alias("n_extra"),
        F.sum("price_usd").alias("revenue"),
    )


def primaries(orders: DataFrame, products: DataFrame) -> DataFrame:
    """(order, primary product) with its lines, for the orders in scope (a row per order)."""
    held = products.where("n_main > 0").select(
        "order_id", F.col("product_id").alias("primary_product_id"), "n_main"
    )
    return orders.select("order_id").join(held, "order_id")


def pairings(mains: DataFrame, products: DataFrame) -> DataFrame:
    """(order, primary product, add-on product) with both line counts.

    The join is at the grain of products, so lines of an order are never multiplied;
    an order with very many products is split by the adaptive skew join.
    """
    held = products.where("n_extra > 0").select(
        "order_id", F.col("product_id").alias("crosssell_product_id"), "n_extra"
    )
    return mains.join(held, "order_id")
