"""Analyses on the hand-made shop; every figure was worked out by hand."""

import datetime as dt

import pytest

from shopgrain.functions.timebucket import ALWAYS, Span
from shopgrain.plans import (
    audit,
    basket,
    channels,
    customer,
    experiment,
    funnel,
    growth,
    product,
    sizing,
)
from tests.conftest import one, rows, ts

DETAIL = ["/item-1", "/item-2"]
Y2012 = Span.of_year(2012)


def pick(df, *names):
    return [tuple(r[n] for n in names) for r in rows(df)]


# --- growth ----------------------------------------------------------------------


def test_conversion_keeps_sessions_without_orders(shop):
    got = pick(growth.conversion_rate(shop.sessions, shop.orders), "qtr", "sessions", "orders", "conv_rate_pct")
    assert got == [(1, 1, 0, 0.0), (2, 2, 1, 50.0), (3, 10, 3, 30.0)]


def test_revenue_is_null_without_orders(shop):
    got = pick(growth.average_order_value(shop.sessions, shop.orders), "qtr", "total_revenue", "avg_order_value")
    assert got == [(1, None, None), (2, 50.0, 50.0), (3, 130.0, 43.33)]
    got = pick(growth.revenue_per_session(shop.sessions, shop.orders), "qtr", "rev_per_session")
    assert got == [(1, None), (2, 25.0), (3, 13.0)]


def test_quarter_status(shop):
    got = pick(growth.quarterly_growth(shop.sessions, shop.orders), "qtr", "quarter_status")
    assert got == [(1, "Partial"), (2, "Complete"), (3, "Complete")]


def test_master_drops_orphan_only_sessions_after_the_join(shop):
    got = pick(
        growth.master_kpis(shop.sessions, shop.orders, shop.order_items),
        "qtr", "sessions", "orders", "avg_order_value", "rev_per_session", "total_revenue",
    )
    # Session 13 has orphan lines only, session 10 is an excluded source; the
    # order without lines (106) counts, the mixed order (103) keeps its good line.
    assert got == [(1, 1, 0, None, None, None), (2, 2, 1, 72.0, 36.0, 72.0), (3, 8, 2, 30.0, 7.5, 60.0)]


def test_channel_columns(shop):
    august = rows(growth.channel_split(shop.sessions, shop.orders))[-1]
    assert (august["yr"], august["mo"]) == (2012, 8)
    assert august["organic_sessions"] == 1 and august["organic_orders"] == 1
    assert august["direct_sessions"] == 2 and august["direct_orders"] == 1
    assert august["bsearch_brand_sessions"] == 1 and august["bsearch_brand_orders"] == 0
    assert august["gsearch_brand_sessions"] == 0


def test_device_and_campaign_columns(shop):
    june = rows(growth.device_split(shop.sessions, shop.orders))[1]
    assert (june["desktop_sessions"], june["desktop_orders"], june["mobile_sessions"]) == (1, 1, 1)
    june = rows(growth.campaign_split(shop.sessions, shop.orders))[1]
    assert (june["nonbrand_sessions"], june["brand_sessions"]) == (2, 0)


# --- channels --------------------------------------------------------------------


def test_monthly_mix(shop):
    august = rows(channels.monthly_mix(shop.sessions))[-1]
    assert august == {
        "yr": 2012, "mo": 8, "gsearch_nonbrand": 1, "bsearch_nonbrand": 0, "paid_brand": 2,
        "organic_search": 1, "direct_typein": 2, "total_sessions": 7,
        "free_brand_pct_of_nonbrand": 500.0,
    }


def test_order_mix(shop):
    q3 = rows(channels.quarterly_order_mix(shop.sessions, shop.orders))[-1]
    assert (q3["total_orders"], q3["gsearch_nb_orders"], q3["organic_orders"], q3["direct_orders"]) == (3, 1, 1, 1)
    assert (q3["gsearch_nb_pct"], q3["free_and_brand_pct"]) == (33.3, 66.7)


def test_resilience(shop):
    got = one(channels.resilience(shop.sessions, Y2012))
    assert got == {"total_sessions": 12, "free_and_brand_sessions": 5, "resilience_score_pct": 41.7}


def test_channel_rows_add_up_to_the_master(shop):
    assert all(r["matches"] for r in rows(channels.reconcile_channels(shop.sessions, shop.orders, shop.order_items)))


def test_weekly_volume_uses_first_date_seen(shop):
    got = pick(channels.weekly_volume(shop.sessions, ALWAYS), "week_start", "gsearch_sessions")
    assert (dt.date(2012, 6, 16), 1) in got and (dt.date(2012, 6, 17), 1) in got
    assert (dt.date(2012, 7, 28), 2) in got


def test_source_by_device(shop):
    got = pick(channels.source_by_device(shop.sessions, shop.orders), "channel", "device", "sessions", "orders")
    assert got == [("gsearch", "desktop", 4, 2), ("gsearch", "mobile", 2, 0)]


# --- funnel ----------------------------------------------------------------------


def test_funnel_counts_lander_visited_at_any_time(shop):
    scope = funnel.entry_scope(Y2012)
    got = one(funnel.rates(shop.sessions, shop.pageviews, DETAIL, scope))
    assert [got[f"sessions_at_{s}"] for s in ["lander", *funnel.steps(DETAIL)]] == [5, 1, 1, 1, 0, 2, 1]
    assert got["lander_to_products_pct"] == 20.0
    assert got["shipping_to_billing_pct"] is None  # nobody at shipping


def test_funnel_by_device_and_product(shop):
    scope = funnel.entry_scope(Y2012)
    got = one(funnel.by_device(shop.sessions, shop.pageviews, DETAIL, scope))
    assert (got["desktop_at_lander"], got["mobile_at_lander"], got["desktop_at_billing"]) == (3, 2, 2)
    got = one(funnel.by_product_page(shop.sessions, shop.pageviews, {"a": "/item-1", "b": "/item-2"}, scope))
    assert (got["a_at_detail"], got["a_at_cart"], got["a_at_billing"], got["b_at_detail"]) == (1, 1, 1, 0)
    assert got["a_detail_to_cart_pct"] == 100.0 and got["b_detail_to_cart_pct"] is None


def test_site_funnel_keeps_sessions_without_views(shop):
    got = one(funnel.site_funnel(shop.sessions, shop.pageviews, DETAIL, Y2012))
    assert (got["total_sessions"], got["reached_cart"], got["reached_billing"]) == (12, 1, 2)
    empty = one(funnel.site_funnel(shop.sessions, shop.pageviews, DETAIL, Span.of_year(1999)))
    assert empty["total_sessions"] == 0 and empty["reached_cart"] == 0


# --- experiments -----------------------------------------------------------------


def test_entry_page_is_not_the_visited_page(shop):
    got = {r["entry_page"]: r["sessions"] for r in rows(experiment.entry_pages(shop.sessions, shop.pageviews))}
    assert got == {"/home": 2, "/lander-1": 4}


def test_bounce_window_ends_at_midnight(shop):
    got = pick(experiment.bounce_rate(shop.sessions, shop.pageviews), "landing_page", "total_sessions", "bounced_sessions")
    assert got == [("/lander-1", 1, 1)]  # session 4 at 00:00:00, not session 5 at 10:00
    wide = experiment.bounce_rate(shop.sessions, shop.pageviews, span=Y2012)
    assert pick(wide, "landing_page", "total_sessions", "bounced_sessions", "bounce_rate_pct") == [
        ("/home", 2, 1, 50.0), ("/lander-1", 4, 2, 50.0),
    ]


def test_first_seen_and_first_sessions(shop):
    assert one(experiment.first_seen(shop.sessions, shop.pageviews))["first_seen"] == ts("2012-06-16 09:00:00")
    got = pick(experiment.first_sessions(shop.sessions, shop.pageviews, n=2), "website_session_id", "landing_page")
    assert got == [(2, "/lander-1"), (3, "/lander-1")]


def test_routing_and_after_test(shop):
    got = pick(experiment.weekly_routing(shop.sessions, shop.pageviews), "yr_wk", "home_sessions", "lander1_sessions")
    assert got == [(201224, 0, 1), (201225, 0, 1), (201230, 1, 1), (201233, 0, 1)]
    got = one(experiment.after_test(shop.sessions, shop.pageviews, shop.orders))
    assert got == {"post_test_sessions": 1, "total_orders": 1, "overall_aov": 40.0}


def test_checkout_fan_out(shop):
    def run(safe):
        df = experiment.checkout_test(shop.sessions, shop.pageviews, shop.orders, span=Y2012, grain_safe=safe)
        return pick(df, "billing_page", "billing_sessions", "orders", "revenue_per_billing_session")

    assert run(False) == [("/billing", 2, 2, 65.0), ("/billing-2", 1, 1, 40.0)]
    assert run(True) == [("/billing", 2, 2, 45.0), ("/billing-2", 1, 1, 40.0)]


def test_values_of_the_winners(shop):
    test = experiment.landing_conversion(shop.sessions, shop.pageviews, shop.orders, span=Y2012)
    assert pick(test, "landing_page", "sessions", "orders", "conv_rate_pct") == [
        ("/home", 2, 0, 0.0), ("/lander-1", 4, 2, 50.0),
    ]
    after = experiment.after_test(shop.sessions, shop.pageviews, shop.orders)
    assert one(experiment.landing_value(test, after))["incremental_revenue"] == 20.0
    bill = experiment.checkout_test(shop.sessions, shop.pageviews, shop.orders, span=Y2012)
    seen = experiment.page_sessions(shop.sessions, shop.pageviews, span=Span.of_month(2012, 8))
    assert one(experiment.checkout_value(bill, seen))["monthly_value"] == -25.0


def test_two_arms(shop):
    got = pick(experiment.two_arm_test(shop.pageviews, shop.orders), "saw_variant", "sessions", "orders")
    assert got == [(0, 1, 1), (1, 1, 1)]


# --- products --------------------------------------------------------------------


def test_monthly_margin(shop):
    got = pick(product.monthly_margin(shop.orders, shop.order_items), "mo", "orders", "total_revenue", "total_margin", "margin_pct")
    assert got == [(6, 1, 72.0, 43.0, 59.7), (8, 1, 60.0, 36.0, 60.0)]


def test_product_orders(shop):
    ids = {"one": 1, "two": 2}
    got = pick(product.monthly_product_orders(shop.orders, shop.order_items, ids, ALWAYS), "mo", "total_orders", "one_orders", "two_orders")
    assert got == [(6, 1, 1, 1), (8, 1, 1, 0)]
    main = product.monthly_product_orders(shop.orders, shop.order_items, ids, ALWAYS, primary_only=True, suffix="primary")
    assert pick(main, "mo", "one_primary", "two_primary") == [(6, 1, 0), (8, 1, 0)]


def test_launch_impact(shop):
    df = product.launch_impact(shop.sessions, shop.orders, shop.order_items, "2012-07-01", Y2012)
    got = pick(df, "period", "sessions", "orders", "products_per_order", "avg_order_value")
    # No channel is excluded here, so session 10 counts; session 13 still leaves.
    assert got == [("A_before", 3, 1, 3.0, 72.0), ("B_after", 9, 2, 0.5, 30.0)]


def test_refund_fan_out(shop):
    def run(safe):
        df = product.monthly_refunds(shop.orders, shop.order_items, shop.refunds, shop.products, grain_safe=safe)
        return pick(df, "mo", "product_id", "items_sold", "items_refunded", "refund_rate_pct")

    assert run(False) == [(6, 1, 2, 2, 100.0), (6, 2, 2, 0, 0.0), (8, 1, 1, 0, 0.0)]
    assert run(True) == [(6, 1, 1, 1, 100.0), (6, 2, 2, 0, 0.0), (8, 1, 1, 0, 0.0)]


def test_lifetime_fan_out(shop):
    def run(safe):
        df = product.lifetime_summary(shop.orders, shop.order_items, shop.refunds, shop.products, safe)
        return pick(df, "product_id", "lifetime_orders", "lifetime_revenue", "lifetime_margin", "lifetime_refund_rate_pct")

    assert run(False) == [(1, 2, 160.0, 96.0, 66.67), (2, 1, 22.0, 13.0, 0.0)]
    assert run(True) == [(1, 2, 110.0, 66.0, 50.0), (2, 1, 22.0, 13.0, 0.0)]


def test_net_margin_and_periods(shop):
    life = product.lifetime_summary(shop.orders, shop.order_items, shop.refunds, shop.products, True)
    assert pick(product.net_margin(life), "product_id", "net_margin_pct") == [(2, 59.1), (1, 30.0)]
    spans = {"a": Span("2012-01-01", "2012-07-01"), "b": Span("2012-07-01", "2013-01-01")}
    got = product.refund_periods(shop.orders, shop.order_items, shop.refunds, 1, spans)
    assert pick(got, "period", "items_sold", "items_refunded") == [("a", 2, 2), ("b", 1, 0)]


# --- baskets ---------------------------------------------------------------------


def test_feature_launch_fan_out(shop):
    def run(safe):
        return one(
            basket.feature_launch(
                shop.sessions, shop.pageviews, shop.orders, shop.order_items, {"all": Y2012}, grain_safe=safe
            )
        )

    written, safe = run(False), run(True)
    assert (written["cart_sessions"], written["orders"], written["cart_to_order_ctr_pct"]) == (1, 1, 100.0)
    assert (written["avg_products_per_order"], written["aov_usd"]) == (6.0, 144.0)
    assert (safe["avg_products_per_order"], safe["aov_usd"]) == (3.0, 72.0)


def test_attachment_matrix(shop):
    got = rows(basket.attachment_matrix(shop.orders, shop.order_items, ALWAYS))
    assert got == [
        {
            "primary_product_id": 1, "crosssell_product_id": 2, "orders_with_pairing": 1,
            "total_primary_orders": 2, "attachment_rate_pct": 50.0,
        }
    ]


def test_basket_value_repeats_for_equal_add_ons(shop):
    written = basket.basket_values(shop.orders, shop.order_items, ALWAYS)
    safe = basket.basket_values(shop.orders, shop.order_items, ALWAYS, grain_safe=True)
    assert one(written)["avg_basket_value_usd"] == 144.0
    assert one(safe)["avg_basket_value_usd"] == 72.0
    assert one(basket.pairing_totals(safe))["total_value_usd"] == 72.0


def test_attach_rate_keeps_zero_rows(shop):
    got = pick(basket.attach_rate(shop.order_items, 3, "2012-01-01"), "primary_product", "primary_orders", "xsell_orders", "attach_rate")
    assert got == [(1, 2, 0, 0.0)]
    own = basket.attach_rate(shop.order_items, 1, "2012-01-01")
    assert one(own)["attach_rate"] == 100.0
    assert one(basket.attach_rate(shop.order_items, 1, "2012-01-01", addons_only=True))["attach_rate"] == 0.0


# --- customers -------------------------------------------------------------------


def test_visit_buckets(shop):
    assert pick(customer.visit_buckets(shop.sessions, Y2012), "session_bucket", "user_count") == [
        ("1 session", 7), ("2 sessions", 3),
    ]


def test_days_to_return(shop):
    got = one(customer.days_to_return(shop.sessions, Y2012))
    assert got == {"min_days_to_return": 1, "max_days_to_return": 139, "avg_days_to_return": 64.0}


@pytest.mark.parametrize(
    ("times", "gap"),
    [
        (["2014-05-01 23:59:00", "2014-05-02 00:01:00"], 1),
        (["2014-05-01 10:00:00", "2014-05-01 10:00:00", "2014-05-09 10:00:00"], 0),
        (["2014-05-01 10:00:00", "2014-05-09 10:00:00", "2014-05-20 10:00:00"], 8),
    ],
)
def test_gap_is_in_calendar_days(spark, times, gap):
    data = [(i, ts(t), 1) for i, t in enumerate(times)]
    df = spark.createDataFrame(data, "website_session_id bigint, created_at timestamp_ntz, user_id bigint")
    assert one(customer.days_to_return(df))["max_days_to_return"] == gap


def test_new_and_repeat(shop):
    mix = pick(customer.channel_mix(shop.sessions, Y2012), "session_type", "gsearch_nonbrand", "paid_brand", "organic", "direct", "total_sessions")
    assert mix == [("New", 6, 1, 0, 1, 9), ("Repeat", 0, 1, 1, 1, 3)]
    conv = pick(customer.conversion(shop.sessions, shop.orders, Y2012), "session_type", "sessions", "orders", "rev_per_session_usd")
    assert conv == [("New", 9, 2, 10.0), ("Repeat", 3, 2, 30.0)]


def test_value_per_user(shop):
    got = pick(customer.value_per_user(shop.sessions, shop.orders, Y2012), "user_type", "users", "avg_sessions_per_user", "avg_orders_per_user", "avg_revenue_per_user")
    assert got == [("Single visit", 6, 1.0, 0.17, 6.67), ("Returned at least once", 3, 2.0, 1.0, 46.67)]


def test_repeat_buyers(shop):
    assert pick(customer.repeat_buyers(shop.orders), "user_id", "total_orders", "lifetime_margin") == [(2, 2, 48.0)]


# --- sizing ----------------------------------------------------------------------


def test_leak_value_does_not_round_in_between(spark):
    # The published inputs and results of this estimate.
    funnel_row = spark.createDataFrame([(12079, 43.4)], "sessions_at_product_detail bigint, detail_to_cart_pct double")
    aov = spark.createDataFrame([(63.79,)], "avg_order_value double")
    assert one(sizing.leak_value(funnel_row, aov)) == {
        "avg_monthly_sessions_at_detail": 383.5,
        "current_detail_to_cart_pct": 43.4,
        "improved_detail_to_cart_pct": 53.4,
        "additional_orders_per_month": 38.0,
        "additional_revenue_per_month": 2446.35,
    }


def test_budget_sizing(spark):
    # The published inputs and results of these estimates.
    averages = spark.createDataFrame(
        [(24016.0, 1893.67, 63.88, 0.0787, 5.03, 11878.0, 5398.0, 0.451, 0.352)],
        "sessions double, orders double, order_value double, conversion double, "
        "revenue_per_session double, detail double, cart double, detail_to_cart double, cart_to_order double",
    )
    redesign = one(sizing.page_redesign(averages))
    assert (redesign["extra_carts"], redesign["extra_orders"], redesign["payback_months"]) == (1188.0, 418.0, 1.5)
    push = one(sizing.cross_sell_push(averages, 24.99))
    assert (push["extra_units"], push["payback_months"]) == (95.0, 10.6)
    users = spark.createDataFrame(
        [("Single visit", 4.65), ("Returned at least once", 12.42)], "user_type string, avg_revenue_per_user double"
    )
    paid = rows(sizing.paid_scale_up(averages, users))
    assert [r["sessions"] for r in paid] == [46667.0, 23333.0]
    assert [r["return_on_spend"] for r in paid] == [6.7, 3.4]
    # 5.03 x 12.42 / 4.65 = 13.435 less a hair
    assert paid[0]["value_multiple"] == 2.67 and paid[0]["break_even_cost"] == 13.43


# --- audit -----------------------------------------------------------------------


def test_audit_counts(shop):
    assert one(audit.bad_price_count(shop.orders))["bad_prices"] == 2
    assert {r["order_id"] for r in rows(audit.bad_price_rows(shop.orders))} == {102, 105}
    assert one(audit.null_count(shop.orders, ["price_usd", "cogs_usd"], "n"))["n"] == 1
    assert one(audit.orphan_count(shop.order_items, shop.products, "product_id"))["orphan_rows"] == 2
    assert {r["order_item_id"] for r in rows(audit.orphan_rows(shop.order_items, shop.products, "product_id"))} == {5, 6}
    assert one(audit.early_child_count(shop.pageviews, shop.sessions, "website_session_id"))["early_rows"] == 1
    assert audit.timely_pageviews(shop.pageviews, shop.sessions).count() == shop.pageviews.count() - 1
    assert one(audit.busiest_user(shop.sessions))["max_sessions_per_user"] == 2
    assert one(audit.untrimmed_count(shop.sessions))["dirty_sources"] == 3
    assert {r["pageview_url"] for r in rows(audit.distinct_values(shop.pageviews, ["pageview_url"]))} == {
        "/home", "/lander-1", "/Lander-1", "/Products", "/item-1", "/Cart", "/cart", "/billing",
        "/billing-2", "/thank-you-for-your-order",
    }


def test_exclusion_summary(shop):
    got = {r["issue"]: (r["records"], r["action"]) for r in rows(audit.exclusion_summary(shop))}
    assert {k: v[0] for k, v in got.items()} == {
        "duplicate sessions": 0, "bad price orders": 2, "early page views": 1,
        "orphan order items": 2, "untrimmed tags": 3, "untrimmed referers": 2,
    }


def test_duplicates_and_quarantine(spark, shop):
    again = shop.sessions.unionByName(shop.sessions.where("website_session_id = 3"))
    assert pick(audit.duplicate_keys(again, ["website_session_id"]), "website_session_id", "cnt") == [(3, 2)]
    assert pick(audit.copies_of_key(again, "website_session_id", 3), "cnt") == [(2,)]
    good, held = audit.quarantine(again)
    assert (good.count(), held.count()) == (12, 2)
    nulls = spark.createDataFrame([(None, 1), (None, 1), (2, 1)], "user_id int, created_at int")
    good, held = audit.quarantine(nulls)
    assert (good.count(), held.count()) == (1, 2)  # NULL keys are equal here


def test_intake_splits_every_row(spark):
    data = [(1, 5), (1, 5), (1, 6), (2, 0), (2, 7), (3, -1), (4, None)]
    df = spark.createDataFrame(data, "id int, price_usd int")
    ok, log = audit.intake(df, ["id"])
    assert sorted(tuple(r.values()) for r in rows(ok)) == sorted([(1, 5), (2, 7), (4, None)], key=str)
    rejected = {(r["id"], r["reason"]): r["n_rows"] for r in rows(log)}
    assert rejected == {(1, "key_exists"): 2, (2, "bad_price"): 1, (3, "bad_price"): 1}
    assert ok.count() + sum(rejected.values()) == len(data)


def test_deviations(shop):
    now = audit.profile(shop.orders)
    got = {r["metric"]: r["flagged"] for r in rows(audit.deviations(now, now))}
    assert not any(got.values()) and len(got) == 6
    less = audit.profile(shop.orders.where("order_id > 103"))
    assert {r["metric"] for r in rows(audit.deviations(less, now)) if r["flagged"]} >= {"max_price"}
