"""Schemas of the six logical tables."""

from __future__ import annotations

from pyspark.sql.types import (
    DecimalType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

MONEY = DecimalType(18, 2)


def _table(*cols: tuple) -> StructType:
    return StructType([StructField(name, dtype, nullable) for name, dtype, nullable in cols])


SESSIONS = _table(
    ("website_session_id", LongType(), False),
    ("created_at", TimestampNTZType(), True),
    ("user_id", LongType(), True),
    ("is_repeat_session", IntegerType(), True),
    ("utm_source", StringType(), True),
    ("utm_campaign", StringType(), True),
    ("device_type", StringType(), True),
    ("http_referer", StringType(), True),
)

PAGEVIEWS = _table(
    ("website_pageview_id", LongType(), False),
    ("created_at", TimestampNTZType(), True),
    ("website_session_id", LongType(), True),
    ("pageview_url", StringType(), True),
)

ORDERS = _table(
    ("order_id", LongType(), False),
    ("created_at", TimestampNTZType(), True),
    ("website_session_id", LongType(), True),
    ("user_id", LongType(), True),
    ("primary_product_id", LongType(), True),
    ("price_usd", MONEY, True),
    ("cogs_usd", MONEY, True),
)

ORDER_ITEMS = _table(
    ("order_item_id", LongType(), False),
    ("created_at", TimestampNTZType(), True),
    ("order_id", LongType(), True),
    ("product_id", LongType(), True),
    ("is_primary_item", IntegerType(), True),
    ("price_usd", MONEY, True),
    ("cogs_usd", MONEY, True),
)

REFUNDS = _table(
    ("order_item_refund_id", LongType(), False),
    ("created_at", TimestampNTZType(), True),
    ("order_item_id", LongType(), True),
)

PRODUCTS = _table(
    ("product_id", LongType(), False),
    ("product_name", StringType(), True),
)

# Table name as stored -> schema.
TABLES = {
    "website_sessions": SESSIONS,
    "website_pageviews": PAGEVIEWS,
    "orders": ORDERS,
    "order_items": ORDER_ITEMS,
    "order_item_refunds": REFUNDS,
    "products": PRODUCTS,
}

# The key of each table is its first column.
KEYS = {name: table.fieldNames()[0] for name, table in TABLES.items()}
