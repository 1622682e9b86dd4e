"""Binding of the given star-schema tables to the logical shop tables.

``events`` becomes a web shop: one visit per (user, day), one page view per
event, one order per purchase event. ``orders``, ``lineitem`` and ``part``
become a store: orders, order lines, refunds and products. Web orders share
their ids with the order lines, so chains from session to line work too.

Dirty data (case variants, blanks, missing tags, bad prices, orphan products,
clock drift) is derived by fixed rules from the ``k`` number of an event or from
the keys of a row. Event dates are spread over years, by 36 days per day (for some
users a multiple) plus a per-user offset below 36, so that monthly and weekly reports
have rows; but for the few visits with a clock fault, the order of a user's visits does
not change.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopgrain.schemas import KEYS
from shopgrain.sources.tables import Shop, load_once

# Fixed values of this binding.
DETAIL_PAGES = ("/item-1", "/item-2", "/item-3", "/item-4")
PRODUCT_COUNT = 6
FIRST_EVENT_DAY = "2024-01-01"
FIRST_SHOP_DAY = "2012-03-19"
SESSION_ID_EPOCH = "2020-01-01"
SPREAD_DAYS = 36
STOPPED_CLOCK = "2014-06-01 00:00:00"

# Type of a price.
_PRICE = "decimal(18,2)"

# Users differ in how far apart their visits are (by user id modulo five: times 36 days)
# and when they begin (days after FIRST_SHOP_DAY), so that a year has users with one, two,
# three and more visits, and new ones.
USER_PACE = (1, 8, 4, 1, 1)
USER_START = (0, 0, 0, 690, 0)


# Declared schemas: reading needs no job to look at the files first.
_TABLES = {
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
        "value double, props string"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
}


def read_given(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.schema(_TABLES[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")


# The mapping is written as SQL expressions: one parse per column.

# Days from FIRST_EVENT_DAY, and the number of days a visit moves.
_DAY = f"datediff(to_date(ts), date'{FIRST_EVENT_DAY}')"
def _by_user(values: Sequence[int]) -> str:
    whens = " ".join(f"when {i} then {v}" for i, v in enumerate(values[:-1]))
    return f"case pmod(user_id, {len(values)}) {whens} else {values[-1]} end"


_SHIFT = (
    f"datediff(date'{FIRST_SHOP_DAY}', date'{FIRST_EVENT_DAY}') "
    f"+ {_DAY} * ({SPREAD_DAYS} * ({_by_user(USER_PACE)}) - 1) + ({_by_user(USER_START)}) "
    f"+ pmod(user_id * 7 + {_DAY} * 5, {SPREAD_DAYS})"
)


def spread(events: DataFrame) -> DataFrame:
    """Events with session id, ``k`` and the spread timestamp; a projection only."""
    return events.selectExpr(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "value",
        # NULL where there is no k.
        "try_cast(get_json_object(props, '$.k') as int) as k",
        f"user_id * 100000 + datediff(to_date(ts), date'{SESSION_ID_EPOCH}') as website_session_id",
        f"ts + make_dt_interval(cast({_SHIFT} as int)) as created_at",
    )


def site_events(spark: SparkSession, folder: str) -> DataFrame:
    return spread(read_given(spark, folder, "events"))


def _ladder(steps: Sequence[tuple[int, str]], rest: str = "null") -> str:
    """CASE with the value of the first step whose bound is above ``k``."""
    whens = " ".join(f"when k < {bound} then {value}" for bound, value in steps)
    return f"case {whens} else {rest} end"


# Tags by k of the first event of a visit.
_SOURCE = _ladder(
    [
        (45, "'gsearch'"),
        (55, "'bsearch'"),
        (61, "'gsearch'"),
        (65, "'bsearch'"),
        (70, "'socialbook'"),
        (72, "'otherads'"),
        (73, "''"),
    ]
)
_CAMPAIGN = _ladder([(55, "'nonbrand'"), (65, "'brand'"), (70, "'pilot'"), (72, "'brand'")])
_REFERER = _ladder(
    [
        (72, "concat('https://www.', source, '.com')"),
        (73, "null"),
        (87, "if(k % 2 = 0, 'https://www.gsearch.com', 'https://www.bsearch.com')"),
        (92, "null"),
        (96, "''"),
        (100, "'  '"),
    ]
)

# Page by event type and k.
_PAGES = {
    "view": [(45, "'/home'"), (90, "'/lander-1'"), (100, "'/Home'")],
    "click": [
        (20, "'/lander-1'"),
        (35, "'/home'"),
        (65, "'/products'"),
        (68, "'/Products'"),
        (78, "'/item-1'"),
        (86, "'/item-2'"),
        (93, "'/item-3'"),
        (100, "'/Item-4'"),
    ],
    "signup": [
        (25, "'/item-1'"),
        (40, "'/item-2'"),
        (75, "'/cart'"),
        (80, "'/Cart'"),
        (100, "'/shipping'"),
    ],
    "error": [(45, "'/billing'"), (90, "'/billing-2'"), (100, "'/shipping'")],
    "purchase": [(100, "'/thank-you-for-your-order'")],
}


def _capital(c: str) -> str:
    return f"concat(upper(substring({c}, 1, 1)), substring({c}, 2))"


def _dirty_source(k: str) -> str:
    return (
        f"case {k} % 10 when 1 then {_capital(_SOURCE)} when 2 then upper({_SOURCE})"
        f" when 3 then concat(' ', {_SOURCE}) else {_SOURCE} end"
    )


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (user, day); tags come from the first event of the visit.

    The window for the repeat flag sees one row per calendar day of a user.
    """
    visits = (
        site_events(spark, folder)
        .groupBy("website_session_id")
        .agg(
            F.expr("min(user_id) as user_id"),
            F.expr("min(created_at) as started_at"),
            F.expr("min_by(k, event_id) as k"),
        )
        .selectExpr(
            "*",
            f"{_SOURCE} as source",
            f"if(k = 83, 'brand', {_CAMPAIGN}) as campaign",
            "if(pmod(user_id + k, 10) < 7, 'desktop', 'mobile') as device",
        )
        .selectExpr("*", f"{_REFERER} as referer")
    )
    return visits.selectExpr(
        "website_session_id",
        # A clock that stands still gives visits of one user the same moment.
        "case when k % 50 = 7 then started_at + interval '3' minute"
        f" when k % 50 = 9 then timestamp_ntz'{STOPPED_CLOCK}' else started_at end as created_at",
        "user_id",
        "cast(website_session_id > min(website_session_id) over (partition by user_id) as int)"
        " as is_repeat_session",
        f"{_dirty_source('k')} as utm_source",
        "case k % 10 when 4 then upper(campaign) when 5 then concat(campaign, ' ')"
        " else campaign end as utm_campaign",
        f"case k % 10 when 6 then {_capital('device')} when 7 then concat(device, ' ')"
        " else device end as device_type",
        "if(k % 10 = 8, concat(' ', referer), referer) as http_referer",
    )


def pageviews(spark: SparkSession, folder: str) -> DataFrame:
    whens = " ".join(
        f"when '{kind}' then {_ladder(steps[:-1], steps[-1][1]) if steps[1:] else steps[0][1]}"
        for kind, steps in _PAGES.items()
    )
    return site_events(spark, folder).selectExpr(
        "event_id as website_pageview_id",
        "created_at",
        "website_session_id",
        f"case event_type {whens} end as pageview_url",
    )


def purchases(events: DataFrame, *more: str) -> DataFrame:
    """Purchase events as orders; some prices are zero, negative or missing."""
    price = (
        "case when k = 77 then null when k % 25 = 0 then 0 "
        f"when k % 25 = 1 then -cast(value as {_PRICE}) else cast(value as {_PRICE}) end"
    )
    return (
        events.where("event_type = 'purchase'")
        .selectExpr("*", f"cast({price} as {_PRICE}) as price_usd")
        .selectExpr(
            "event_id as order_id",
            "created_at",
            "website_session_id",
            "user_id",
            f"cast(1 + k % {PRODUCT_COUNT} as bigint) as primary_product_id",
            "price_usd",
            f"if(k = 33, price_usd, cast(price_usd * 0.40BD as {_PRICE})) as cogs_usd",
            "ts",
            *more,
        )
    )


ARRIVAL_PARTS, PART_DAYS = 4, 8


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """Web orders as they reach a gate, with the ``part`` in which they come.

    Parts follow the clock. Some orders come one part late, and some come again, in the
    same or in the next part.
    """
    part = f"least({_DAY} div {PART_DAYS}, {ARRIVAL_PARTS - 1}) + if(k % 13 = 5, 1, 0)"
    orders = purchases(site_events(spark, folder), "k").withColumn(
        "utm_source", F.expr(_dirty_source("k"))
    )
    once = orders.withColumn("part", F.expr(part))
    again = once.where("k % 11 = 3").withColumn("part", F.expr("part + k % 2"))
    return once.unionByName(again).drop("k")


def web_orders(spark: SparkSession, folder: str) -> DataFrame:
    return purchases(site_events(spark, folder)).drop("ts")


def store_orders(spark: SparkSession, folder: str) -> DataFrame:
    price = (
        f"case when o_orderkey % 50 = 7 then 0 when o_orderkey % 50 = 8 "
        f"then -cast(o_totalprice as {_PRICE}) else cast(o_totalprice as {_PRICE}) end"
    )
    return (
        read_given(spark, folder, "orders")
        .selectExpr("*", f"cast({price} as {_PRICE}) as price_usd")
        .selectExpr(
            "o_orderkey as order_id",
            "o_orderdate as created_at",
            "o_custkey * 100000 as website_session_id",
            "o_custkey as user_id",
            "cast(null as bigint) as primary_product_id",
            "price_usd",
            f"cast(price_usd * 0.60BD as {_PRICE}) as cogs_usd",
        )
    )


# Line key; not unique in the given table, and left so.
_ITEM_ID = "l_orderkey * 8 + l_linenumber"


def order_items(spark: SparkSession, folder: str) -> DataFrame:
    return (
        read_given(spark, folder, "lineitem")
        .selectExpr("*", f"cast(l_extendedprice as {_PRICE}) as price_usd")
        .selectExpr(
            f"{_ITEM_ID} as order_item_id",
            "l_shipdate as created_at",
            "l_orderkey as order_id",
            f"if(l_partkey % 23 = 0, 99, 1 + l_partkey % {PRODUCT_COUNT}) as product_id",
            "cast(l_linenumber = 1 as int) as is_primary_item",
            "price_usd",
            f"cast(price_usd * (1 - cast(l_discount as decimal(4,2))) as {_PRICE}) as cogs_usd",
        )
    )


def refunds(spark: SparkSession, folder: str) -> DataFrame:
    return (
        read_given(spark, folder, "lineitem")
        .where("l_returnflag = 'R'")
        .selectExpr(
            f"({_ITEM_ID}) * 10 + 1 as order_item_refund_id",
            "l_shipdate + make_dt_interval(l_linenumber) as created_at",
            f"{_ITEM_ID} as order_item_id",
        )
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    """Six products: the parts grouped by key; the result has six rows at any size."""
    return (
        read_given(spark, folder, "part")
        .groupBy(F.expr(f"cast(1 + p_partkey % {PRODUCT_COUNT} as bigint) as product_id"))
        .agg(F.expr("min(p_name) as name"))
        .selectExpr("product_id", "concat(name, ' #', product_id) as product_name")
    )


_WEB = {
    "website_sessions": sessions,
    "website_pageviews": pageviews,
    "orders": web_orders,
    "order_items": order_items,
    "order_item_refunds": refunds,
    "products": products,
}


def web_shop(spark: SparkSession, folder: str) -> Shop:
    return Shop(lambda name: _WEB[name](spark, folder))


def store(spark: SparkSession, folder: str) -> Shop:
    """Web visits with the store's own orders."""
    tables = {**_WEB, "orders": store_orders}
    return Shop(lambda name: tables[name](spark, folder))


# Days of the store on which something goes wrong, by a planted rule.
FLOOD_DAY, PRICELESS_DAY = "1999-03-10", "1999-05-20"


def faulty_store_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Store orders with two planted faults: a day whose orders come six times, and one
    whose orders have no price."""
    orders = store_orders(spark, folder).withColumn(
        "price_usd", F.expr(f"if(to_date(created_at) = date'{PRICELESS_DAY}', null, price_usd)")
    )
    again = orders.where(F.expr(f"to_date(created_at) = date'{FLOOD_DAY}'"))
    return orders.unionByName(again.withColumn("_", F.explode(F.sequence(F.lit(1), F.lit(5)))).drop("_"))


def with_copies(shop: Shop) -> Shop:
    """The shop with every seventh row by key standing twice, in all tables with events."""

    def keep(name: str) -> DataFrame:
        df = shop.named()[name]
        return df if name == "products" else df.unionByName(df.where(F.col(KEYS[name]) % 7 == 0))

    return Shop(keep)


def loaded_with_copies(shop: Shop) -> Shop:
    """The shop as loaded from tables in which every seventh row by key stands twice.

    Keys that are not unique in the given tables are left alone, as the load rule would
    skip their rows too.
    """

    def load(name: str) -> DataFrame:
        df, key = shop.named()[name], KEYS[name]
        if name in ("order_items", "order_item_refunds"):
            return df
        return load_once(df.unionByName(df.where(F.col(key) % 7 == 0)), [key])

    return Shop(load)
