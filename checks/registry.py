"""The registered queries: every analysis on the given tables.

A key starts with the inventory id of its analysis. Each callable reads whole
tables below the folder it is given and returns a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from shopgrain.functions.timebucket import Span
from shopgrain.plans import (
    audit,
    baseline,
    basket,
    channels,
    customer,
    experiment,
    facts,
    funnel,
    growth,
    product,
    sizing,
)
from shopgrain.schemas import KEYS, MONEY
from shopgrain.session import work_folder
from shopgrain.sources import loaded, tables, testbed
from shopgrain.sources.tables import Shop
from shopgrain.streaming.intake import REASONS, run_intake

Query = Callable[[SparkSession, str], DataFrame]

DETAIL = testbed.DETAIL_PAGES
PRODUCTS = {f"product{i}": i for i in range(1, testbed.PRODUCT_COUNT + 1)}
Q4_2014 = Span("2014-10-01", "2015-01-01")

# Store data covers 1995 to 2001; these windows stand for the usual ones.
MULTI_PRODUCT = Span("1996-04-01")
CROSS_SELL = Span("1998-12-05", start_open=True)
SUPPLIER_CHANGE = {
    "A_before": Span("1998-06-01", "1998-09-01"),
    "B_change": Span("1998-09-01", "1998-10-01"),
    "C_after": Span("1998-10-01", "1999-01-01"),
}


def plain(df: DataFrame) -> DataFrame:
    """Money as double, so both engines print it alike."""
    money = [f.name for f in df.schema.fields if isinstance(f.dataType, DecimalType)]
    return df.withColumns({name: F.col(name).cast("double") for name in money}) if money else df


def _web(fn: Callable[[Shop], DataFrame]) -> Query:
    return lambda spark, folder: plain(fn(testbed.web_shop(spark, folder)))


def _store(fn: Callable[[Shop], DataFrame]) -> Query:
    return lambda spark, folder: plain(fn(testbed.store(spark, folder)))


def _repeated(fn: Callable[[Shop], DataFrame], make: Callable = testbed.web_shop) -> Query:
    """The analysis on tables in which some rows stand twice, after the load rule."""
    return lambda spark, folder: plain(fn(testbed.loaded_with_copies(make(spark, folder))))


def _with_copies(fn: Callable[[Shop], DataFrame], make: Callable = testbed.web_shop) -> Query:
    """The analysis on tables in which some rows stand twice, as they are."""
    return lambda spark, folder: plain(fn(testbed.with_copies(make(spark, folder))))


def _stored(fn: Callable[[Shop], DataFrame], *names: str) -> Query:
    """The analysis on tables with copies after the stored load, in two overlapping deliveries."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        base = work_folder(spark, "shop")
        given = testbed.with_copies(testbed.web_shop(spark, folder))
        key = {name: F.col(KEYS[name]) for name in names}
        early = Shop(lambda name: given.named()[name].where(key[name] % 2 == 0) if name in key else given.named()[name])
        loaded.load(early, base, buckets=8, tables=names)
        loaded.load(given, base, tables=names)
        return plain(fn(tables.read_shop(spark, base)))

    return query


def _raw(name: str, fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: plain(fn(testbed.read_given(spark, folder, name)))


def _early_lines(spark: SparkSession, folder: str) -> DataFrame:
    return audit.early_child_count(
        testbed.read_given(spark, folder, "lineitem"),
        testbed.read_given(spark, folder, "orders"),
        "l_orderkey",
        parent_key="o_orderkey",
        child_ts="l_shipdate",
        parent_ts="o_orderdate",
    )


def _intake_lines(lines: DataFrame) -> DataFrame:
    factor = F.when(F.col("l_partkey") % 50 == 0, 0).otherwise(1)
    price = F.col("l_extendedprice").cast(MONEY) * factor
    return audit.intake(
        lines.withColumn("price_usd", price), ("l_orderkey", "l_linenumber")
    )[1]


def _intake_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Orders arrive in parts; each part is one run of the gate, which goes on from the last."""
    base = work_folder(spark, "intake")
    arrivals = testbed.arrivals(spark, folder)
    schema = arrivals.drop("part").schema
    for part in range(testbed.ARRIVAL_PARTS + 2):
        arrivals.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(schema).parquet(f"{base}/in")
        run = run_intake(spark, stream, ["order_id"], event_time="ts", delay="1 day", folder=f"{base}/run")
    day = F.to_date("created_at").alias("day")
    accepted = spark.read.parquet(run.accepted).select(day, F.lit("accepted").alias("reason"), "utm_source")
    rejected = spark.read.parquet(run.rejected).select(day, "reason", F.lit(None).cast("string").alias("utm_source"))
    return (
        accepted.unionByName(rejected)
        .groupBy("day")
        .agg(
            F.count("*").alias("n_rows"),
            *[F.count_if(F.col("reason") == r).alias(r) for r in ("accepted", *REASONS)],
            F.size(F.collect_set("utm_source")).cast("long").alias("tags"),  # a handful of tags
        )
    )


def _averages(s: Shop) -> DataFrame:
    return sizing.monthly_averages(
        growth.master_kpis(s.sessions, s.orders, s.order_items, "month", Q4_2014),
        funnel.site_funnel(s.sessions, s.pageviews, DETAIL, Q4_2014, by="month"),
    )


def _lifetime(s: Shop, safe: bool = False) -> DataFrame:
    return product.lifetime_summary(s.orders, s.order_items, s.refunds, s.products, safe)


def _monthly_refunds(s: Shop, safe: bool = False) -> DataFrame:
    return product.monthly_refunds(
        s.orders, s.order_items, s.refunds, s.products, grain_safe=safe
    )


def _landing(s: Shop) -> DataFrame:
    return experiment.landing_conversion(s.sessions, s.pageviews, s.orders)


def _checkout(s: Shop, safe: bool = False) -> DataFrame:
    return experiment.checkout_test(s.sessions, s.pageviews, s.orders, grain_safe=safe)


def _profiles(s: Shop) -> DataFrame:
    return audit.deviations(
        audit.profile(s.orders, span=Span("2014-01-01")),
        audit.profile(s.orders, span=Span(end="2014-01-01")),
    )


def _stored_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """Orders arrive year by year; the days of 1999 are held against the weekdays before them."""
    base = work_folder(spark, "baseline")
    orders = testbed.faulty_store_orders(spark, folder)
    for year in range(1995, 2002):
        baseline.update(orders.where(F.year("created_at") == year), base, str(year))
    in_1999 = F.col("day").between("1999-01-01", "1999-12-31")
    return baseline.compare(baseline.daily(spark, base), weeks=8, least=4, tolerance_pct=150.0, where=in_1999)


def _from_facts(fn: Callable[[DataFrame], DataFrame]) -> Query:
    """The report from stored session facts: all months, then some of them once more."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        base = work_folder(spark, "facts")
        shop = testbed.web_shop(spark, folder)
        facts.refresh(shop, base, DETAIL)
        facts.refresh(shop, base, DETAIL, [(2014, 2), (2014, 11)])
        return plain(fn(facts.open_facts(spark, base)))

    return query


AUDIT: dict[str, Query] = {
    "a1_rows_website_sessions": _web(lambda s: audit.row_count(s.sessions)),
    "a1_rows_website_pageviews": _web(lambda s: audit.row_count(s.pageviews)),
    "a1_rows_orders": _web(lambda s: audit.row_count(s.orders)),
    "a1_rows_order_items": _web(lambda s: audit.row_count(s.order_items)),
    "a1_rows_order_item_refunds": _web(lambda s: audit.row_count(s.refunds)),
    "a1_rows_products": _web(lambda s: audit.row_count(s.products)),
    "a2_table_counts": _web(lambda s: audit.table_counts(s.named())),
    "a3_time_range": _web(lambda s: audit.time_range(s.sessions)),
    "a4_preview": _web(lambda s: tables.preview(s.sessions, ["website_session_id"])),
    "a5_copies_of_key": _web(lambda s: audit.copies_of_key(s.order_items, "order_item_id", 1009)),
    "a5_duplicate_keys": _raw(
        "lineitem", lambda df: audit.duplicate_keys(df, ["l_orderkey", "l_linenumber"])
    ),
    "a6_duplicate_user_time": _raw(
        "orders", lambda df: audit.duplicate_keys(df, ["o_custkey", "o_orderdate"])
    ),
    "a6_duplicate_sessions": _web(
        lambda s: audit.duplicate_keys(s.sessions, ["user_id", "created_at"])
    ),
    "a7_null_times_sessions": _web(
        lambda s: audit.null_count(s.sessions, ["created_at"], "null_timestamps")
    ),
    "a7_null_times_orders": _web(
        lambda s: audit.null_count(s.orders, ["created_at"], "null_order_timestamps")
    ),
    "a7_null_times_pageviews": _web(
        lambda s: audit.null_count(s.pageviews, ["created_at"], "null_pageview_timestamps")
    ),
    "a7_null_times_refunds": _web(
        lambda s: audit.null_count(s.refunds, ["created_at"], "null_refund_timestamps")
    ),
    "a8_bad_price_count": _web(lambda s: audit.bad_price_count(s.orders)),
    "a8_bad_price_rows": _web(lambda s: audit.bad_price_rows(s.orders)),
    "a9_null_prices": _web(
        lambda s: audit.null_count(s.orders, ["price_usd", "cogs_usd"], "null_prices")
    ),
    "a10_bad_item_prices": _web(
        lambda s: audit.bad_price_count(s.order_items, "bad_item_prices")
    ),
    "a11_null_item_prices": _web(
        lambda s: audit.null_count(s.order_items, ["price_usd", "cogs_usd"], "null_prices")
    ),
    "a12_early_pageview_count": _web(
        lambda s: audit.early_child_count(s.pageviews, s.sessions, "website_session_id")
    ),
    "a12_early_lineitem_count": _early_lines,
    "a13_early_pageviews": _web(lambda s: audit.early_pageviews(s.pageviews, s.sessions)),
    "a14_orphan_count": _web(
        lambda s: audit.orphan_count(s.order_items, s.products, "product_id")
    ),
    "a14_orphan_rows": _web(lambda s: audit.orphan_rows(s.order_items, s.products, "product_id")),
    "a15_heavy_users": _web(lambda s: audit.heavy_users(s.sessions, more_than=25)),
    "a16_busiest_user": _web(lambda s: audit.busiest_user(s.sessions)),
    "a17_distinct_tags": _web(lambda s: audit.distinct_values(s.sessions, audit.TAGS)),
    "a18_distinct_urls": _web(lambda s: audit.distinct_values(s.pageviews, ["pageview_url"])),
    "a19_untrimmed_count": _web(lambda s: audit.untrimmed_count(s.sessions)),
    "a19_untrimmed_rows": _web(lambda s: audit.untrimmed_rows(s.sessions)),
    "a20_untrimmed_referer_count": _web(
        lambda s: audit.untrimmed_count(s.sessions, ["http_referer"], "dirty_referers")
    ),
    "a20_untrimmed_referer_rows": _web(
        lambda s: audit.untrimmed_rows(s.sessions, ["http_referer"])
    ),
    "a21_distinct_referers": _web(lambda s: audit.distinct_values(s.sessions, ["http_referer"])),
    "a22_exclusion_summary": _web(audit.exclusion_summary),
    "n8_timely_pageviews": _web(
        lambda s: audit.timely_pageviews(s.pageviews, s.sessions)
        .groupBy("pageview_url")
        .agg(F.count(F.lit(1)).alias("pageviews"))
    ),
    "s2_load_once": _raw(
        "lineitem",
        lambda df: tables.load_once(
            df,
            ["l_orderkey", "l_linenumber"],
            [
                "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                "l_discount", "l_tax", "l_returnflag", "l_linestatus",
            ],
        ),
    ),
}

GROWTH: dict[str, Query] = {
    "b1_quarterly_growth": _web(lambda s: growth.quarterly_growth(s.sessions, s.orders)),
    "b2_channel_growth": _web(lambda s: growth.channel_growth(s.sessions, s.orders)),
    "b3_campaign_split": _web(lambda s: growth.campaign_split(s.sessions, s.orders)),
    "b4_device_split": _web(lambda s: growth.device_split(s.sessions, s.orders)),
    "b5_channel_split": _web(lambda s: growth.channel_split(s.sessions, s.orders)),
    "e1_conversion_rate": _web(lambda s: growth.conversion_rate(s.sessions, s.orders)),
    "e2_average_order_value": _web(lambda s: growth.average_order_value(s.sessions, s.orders)),
    "e3_revenue_per_session": _web(lambda s: growth.revenue_per_session(s.sessions, s.orders)),
    "e4_monthly_conversion": _web(
        lambda s: growth.conversion_rate(s.sessions, s.orders, by="month")
    ),
    "k1_master_kpis": _web(lambda s: growth.master_kpis(s.sessions, s.orders, s.order_items)),
    "k5_monthly_baseline": _web(
        lambda s: growth.master_kpis(s.sessions, s.orders, s.order_items, "month", Q4_2014)
    ),
    "c1_monthly_mix": _web(lambda s: channels.monthly_mix(s.sessions)),
    "c2_quarterly_order_mix": _web(
        lambda s: channels.quarterly_order_mix(s.sessions, s.orders)
    ),
    "c3_source_by_device": _web(lambda s: channels.source_by_device(s.sessions, s.orders)),
    "c4_weekly_volume": _web(lambda s: channels.weekly_volume(s.sessions)),
    "c5_resilience": _web(lambda s: channels.resilience(s.sessions)),
    "k2_quarterly_channels": _web(
        lambda s: channels.quarterly_channels(s.sessions, s.orders, s.order_items)
    ),
    "k7_reconcile_channels": _web(
        lambda s: channels.reconcile_channels(s.sessions, s.orders, s.order_items)
    ),
}

FUNNEL: dict[str, Query] = {
    "d1_funnel_counts": _web(lambda s: funnel.counts(s.sessions, s.pageviews, DETAIL)),
    "d2_funnel_rates": _web(lambda s: funnel.rates(s.sessions, s.pageviews, DETAIL)),
    "d3_funnel_by_product_page": _web(
        lambda s: funnel.by_product_page(
            s.sessions, s.pageviews, {"item1": DETAIL[0], "item2": DETAIL[1]}
        )
    ),
    "d4_funnel_by_device": _web(lambda s: funnel.by_device(s.sessions, s.pageviews, DETAIL)),
    "k3_site_funnel": _web(lambda s: funnel.site_funnel(s.sessions, s.pageviews, DETAIL)),
    "k6_monthly_funnel": _web(
        lambda s: funnel.site_funnel(s.sessions, s.pageviews, DETAIL, Q4_2014, by="month")
    ),
}

EXPERIMENT: dict[str, Query] = {
    "h1_entry_pages": _web(lambda s: experiment.entry_pages(s.sessions, s.pageviews)),
    "x1_first_seen": _web(lambda s: experiment.first_seen(s.sessions, s.pageviews)),
    "x2_first_sessions": _web(lambda s: experiment.first_sessions(s.sessions, s.pageviews)),
    "x3_bounce_rate": _web(lambda s: experiment.bounce_rate(s.sessions, s.pageviews)),
    "x4_weekly_routing": _web(lambda s: experiment.weekly_routing(s.sessions, s.pageviews)),
    "x5_landing_conversion": _web(_landing),
    "x6_after_test": _web(lambda s: experiment.after_test(s.sessions, s.pageviews, s.orders)),
    "x7_checkout_test": _web(_checkout),
    "x7_checkout_test_grain_safe": _web(lambda s: _checkout(s, True)),
    "x8_page_sessions": _web(lambda s: experiment.page_sessions(s.sessions, s.pageviews)),
    "z2_landing_value": _web(
        lambda s: experiment.landing_value(
            _landing(s), experiment.after_test(s.sessions, s.pageviews, s.orders)
        )
    ),
    "z2_checkout_value": _web(
        lambda s: experiment.checkout_value(
            _checkout(s), experiment.page_sessions(s.sessions, s.pageviews)
        )
    ),
    "l7_two_arm_test": _web(lambda s: experiment.two_arm_test(s.pageviews, s.orders)),
}

PRODUCT: dict[str, Query] = {
    "p1_monthly_margin": _store(lambda s: product.monthly_margin(s.orders, s.order_items)),
    "p2_monthly_efficiency": _web(
        lambda s: product.monthly_efficiency(s.sessions, s.orders, s.order_items)
    ),
    "p3_product_orders": _store(
        lambda s: product.monthly_product_orders(s.orders, s.order_items, PRODUCTS, MULTI_PRODUCT)
    ),
    "p4_launch_impact": _web(
        lambda s: product.launch_impact(s.sessions, s.orders, s.order_items)
    ),
    "p5_month_by_product": _store(
        lambda s: product.monthly_by_product(s.orders, s.order_items, s.products)
    ),
    "p6_primary_orders": _store(
        lambda s: product.monthly_product_orders(
            s.orders, s.order_items, PRODUCTS, Span(), primary_only=True, suffix="primary"
        )
    ),
    "p7_launch_impact_other": _web(
        lambda s: product.launch_impact(
            s.sessions, s.orders, s.order_items, "2013-01-06", Span("2012-12-06", "2013-02-06")
        )
    ),
    "p8_monthly_refunds": _store(_monthly_refunds),
    "p8_monthly_refunds_grain_safe": _store(lambda s: _monthly_refunds(s, True)),
    "p9_refund_periods": _store(
        lambda s: product.refund_periods(
            s.orders, s.order_items, s.refunds, periods=SUPPLIER_CHANGE
        )
    ),
    "p10_lifetime_summary": _store(_lifetime),
    "p10_lifetime_summary_grain_safe": _store(lambda s: _lifetime(s, True)),
    "z3_net_margin": _store(lambda s: product.net_margin(_lifetime(s))),
}

BASKET: dict[str, Query] = {
    "m1_feature_launch": _web(
        lambda s: basket.feature_launch(s.sessions, s.pageviews, s.orders, s.order_items)
    ),
    "m1_feature_launch_grain_safe": _web(
        lambda s: basket.feature_launch(
            s.sessions, s.pageviews, s.orders, s.order_items, grain_safe=True
        )
    ),
    "m2_attachment_matrix": _store(
        lambda s: basket.attachment_matrix(s.orders, s.order_items, CROSS_SELL)
    ),
    "m3_basket_values": _store(
        lambda s: basket.basket_values(s.orders, s.order_items, CROSS_SELL)
    ),
    "m3_basket_values_grain_safe": _store(
        lambda s: basket.basket_values(s.orders, s.order_items, CROSS_SELL, grain_safe=True)
    ),
    "m4_attach_rate": _store(lambda s: basket.attach_rate(s.order_items, 4, "1996-02-12")),
    "z4_pairing_totals": _store(
        lambda s: basket.pairing_totals(basket.basket_values(s.orders, s.order_items, CROSS_SELL))
    ),
}

CUSTOMER: dict[str, Query] = {
    "l1_visit_buckets": _web(lambda s: customer.visit_buckets(s.sessions)),
    "l2_days_to_return": _web(lambda s: customer.days_to_return(s.sessions)),
    "l3_channel_mix": _web(lambda s: customer.channel_mix(s.sessions)),
    "l4_conversion": _web(lambda s: customer.conversion(s.sessions, s.orders)),
    "l5_value_per_user": _web(lambda s: customer.value_per_user(s.sessions, s.orders)),
    "l6_repeat_buyers": _store(lambda s: customer.repeat_buyers(s.orders)),
}

SIZING: dict[str, Query] = {
    "z1_leak_value": _web(
        lambda s: sizing.leak_value(
            funnel.rates(s.sessions, s.pageviews, DETAIL),
            growth.overall_order_value(s.sessions, s.orders),
        )
    ),
    "z5_page_redesign": _web(lambda s: sizing.page_redesign(_averages(s))),
    "z5_cross_sell_push": _web(lambda s: sizing.cross_sell_push(_averages(s), unit_price=24.99)),
    "z5_paid_scale_up": _web(
        lambda s: sizing.paid_scale_up(
            _averages(s), customer.value_per_user(s.sessions, s.orders)
        )
    ),
}

VALIDATION: dict[str, Query] = {
    "v1_intake_accepted": _web(
        lambda s: audit.intake(s.orders, ["order_id"])[0].select(
            "order_id", "website_session_id", "user_id", "price_usd"
        )
    ),
    "v1_intake_rejects": _raw("lineitem", _intake_lines),
    "v1_intake_stream": _intake_stream,
    "v2_quarantine": _raw(
        "orders",
        lambda df: audit.quarantine(df, ["o_custkey", "o_orderdate"])[1].select(
            "o_orderkey", "o_custkey", "o_orderdate"
        ),
    ),
    "v2_to_load": _raw(
        "orders",
        lambda df: audit.quarantine(df, ["o_custkey", "o_orderdate"])[0].select(
            "o_orderkey", "o_custkey", "o_orderdate"
        ),
    ),
    "v3_deviations": _web(_profiles),
    "v3_stored_baseline": _stored_baseline,
}

REPEATED: dict[str, Query] = {
    "s2_b5_channel_split": _repeated(lambda s: growth.channel_split(s.sessions, s.orders)),
    "s2_e1_conversion_rate": _repeated(lambda s: growth.conversion_rate(s.sessions, s.orders)),
    "s2_k1_master_kpis": _repeated(lambda s: growth.master_kpis(s.sessions, s.orders, s.order_items)),
    "s2_d2_funnel_rates": _repeated(lambda s: funnel.rates(s.sessions, s.pageviews, DETAIL)),
    "s2_l6_repeat_buyers": _repeated(lambda s: customer.repeat_buyers(s.orders), testbed.store),
}

FACTS: dict[str, Query] = {
    "k1_from_facts": _from_facts(lambda f: facts.master_kpis(f)),
    "k2_from_facts": _from_facts(lambda f: facts.quarterly_channels(f)),
    "k3_from_facts": _from_facts(lambda f: facts.site_funnel(f, DETAIL)),
    "k5_from_facts": _from_facts(lambda f: facts.master_kpis(f, "month", Q4_2014)),
    "k6_from_facts": _from_facts(lambda f: facts.site_funnel(f, DETAIL, Q4_2014, by="month")),
}

STORED: dict[str, Query] = {
    "s2_stored_sessions": _stored(lambda s: s.sessions, "website_sessions"),
    "s2_stored_order_items": _stored(lambda s: s.order_items, "order_items"),
    "s2_stored_orders_by_id": _stored(lambda s: s.orders_by_id, "orders"),
    "s2_stored_b5_channel_split": _stored(
        lambda s: growth.channel_split(s.sessions, s.orders), "website_sessions", "orders"
    ),
    "s2_stored_d2_funnel_rates": _stored(
        lambda s: funnel.rates(s.sessions, s.pageviews, DETAIL), "website_sessions", "website_pageviews"
    ),
}

WITH_COPIES: dict[str, Query] = {
    "g3_copies_b1_quarterly_growth": _with_copies(
        lambda s: growth.quarterly_growth(s.sessions, s.orders, repeats=True)
    ),
    "g4_copies_b5_channel_split": _with_copies(
        lambda s: growth.channel_split(s.sessions, s.orders, repeats=True)
    ),
    "g3_copies_e1_conversion_rate": _with_copies(
        lambda s: growth.conversion_rate(s.sessions, s.orders, repeats=True)
    ),
    "g3_copies_e3_revenue_per_session": _with_copies(
        lambda s: growth.revenue_per_session(s.sessions, s.orders, repeats=True)
    ),
    "g3_copies_k1_master_kpis": _with_copies(
        lambda s: growth.master_kpis(s.sessions, s.orders, s.order_items, repeats=True)
    ),
    "g4_copies_d2_funnel_rates": _with_copies(
        lambda s: funnel.rates(s.sessions, s.pageviews, DETAIL, repeats=True)
    ),
    "g3_copies_p5_month_by_product": _with_copies(
        lambda s: product.monthly_by_product(s.orders, s.order_items, s.products, repeats=True), testbed.store
    ),
    "g3_copies_p8_monthly_refunds": _with_copies(
        lambda s: product.monthly_refunds(s.orders, s.order_items, s.refunds, s.products, repeats=True), testbed.store
    ),
    "g3_copies_p10_lifetime_summary": _with_copies(
        lambda s: product.lifetime_summary(s.orders, s.order_items, s.refunds, s.products, repeats=True), testbed.store
    ),
}

QUERIES: dict[str, Query] = {
    **AUDIT,
    **GROWTH,
    **FUNNEL,
    **EXPERIMENT,
    **PRODUCT,
    **BASKET,
    **CUSTOMER,
    **SIZING,
    **VALIDATION,
    **REPEATED,
    **STORED,
    **FACTS,
    **WITH_COPIES,
}
