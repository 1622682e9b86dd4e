"""Figures that must fit together, on the given tables and after cleaning."""

import pytest
from pyspark.sql import functions as F

from checks.registry import DETAIL, _store, _web
from shopgrain.functions.timebucket import ALWAYS, Span
from shopgrain.operators import keys
from shopgrain.plans import audit, basket, customer, experiment, funnel, growth, product
from shopgrain.sources import testbed
from shopgrain.sources.tables import Shop
from tests.conftest import SF, one, rows


@pytest.fixture(scope="module")
def web(spark):
    return testbed.web_shop(spark, SF)


@pytest.fixture(scope="module")
def store(spark):
    return testbed.store(spark, SF)


def test_no_step_exceeds_the_sessions(web):
    got = one(funnel.site_funnel(web.sessions, web.pageviews, DETAIL, ALWAYS))
    assert all(v <= got["total_sessions"] for v in got.values())


def test_months_of_the_funnel_add_up(web):
    year = Span.of_year(2013)
    whole = one(funnel.site_funnel(web.sessions, web.pageviews, DETAIL, year))
    months = rows(funnel.site_funnel(web.sessions, web.pageviews, DETAIL, year, by="month"))
    for name, value in whole.items():
        assert sum(m[name] for m in months) == value


def test_devices_add_up_to_the_funnel(web):
    scope = funnel.entry_scope(ALWAYS)
    whole = one(funnel.counts(web.sessions, web.pageviews, DETAIL, scope))
    split = one(funnel.by_device(web.sessions, web.pageviews, DETAIL, scope))
    for step in ["lander", *funnel.steps(DETAIL)]:
        assert split[f"desktop_at_{step}"] + split[f"mobile_at_{step}"] == whole[f"sessions_at_{step}"]


def test_new_and_repeat_make_all(web):
    year = Span.of_year(2013)
    mix = sum(r["total_sessions"] for r in rows(customer.channel_mix(web.sessions, year)))
    conv = sum(r["sessions"] for r in rows(customer.conversion(web.sessions, web.orders, year)))
    assert mix == conv > 0


def test_quarters_add_up_to_months(web):
    def total(df):
        return sum(r["sessions"] for r in rows(df)), sum(r["orders"] for r in rows(df))

    quarters = total(growth.conversion_rate(web.sessions, web.orders, "quarter"))
    assert quarters == total(growth.conversion_rate(web.sessions, web.orders, "month"))
    assert quarters[0] == web.sessions.count()


def test_forms_agree_where_keys_are_unique(web, store):
    """Without repeated views, refunds and lines, as-written equals grain-safe."""
    items = keys.first_per_key(store.order_items, ["order_item_id"])
    refunds = keys.first_per_key(store.refunds, ["order_item_id"])
    views = keys.first_per_key(
        web.pageviews.withColumn("pageview_url", F.lower("pageview_url")),
        ["website_session_id", "pageview_url"],
    )
    single = keys.first_per_key(items, ["order_id", "product_id", "is_primary_item"])
    pairs = [
        lambda safe: product.lifetime_summary(store.orders, items, refunds, store.products, safe),
        lambda safe: experiment.checkout_test(web.sessions, views, web.orders, span=ALWAYS, grain_safe=safe),
        lambda safe: basket.feature_launch(
            web.sessions, views, web.orders, web.order_items, {"all": ALWAYS}, grain_safe=safe
        ),
        lambda safe: basket.basket_values(store.orders, single, ALWAYS, safe),
    ]
    for run in pairs:
        written, safe = rows(run(False)), rows(run(True))
        assert written == safe and written


def test_audit_is_clean_after_cleaning(web):
    clean = Shop(
        {
            "website_sessions": keys.first_per_key(
                audit.cleaned_tags(web.sessions, (*audit.TAGS, "http_referer")), ["website_session_id"]
            ),
            "website_pageviews": audit.timely_pageviews(web.pageviews, web.sessions),
            "orders": web.orders.where(~F.coalesce(audit.bad_price(), F.lit(False))),
            "order_items": web.order_items.join(web.products, "product_id", "left_semi"),
            "order_item_refunds": web.refunds,
            "products": web.products,
        }.__getitem__
    )
    assert [r["records"] for r in rows(audit.exclusion_summary(clean))] == [0] * 6
    assert any(r["records"] for r in rows(audit.exclusion_summary(web)))


def test_registered_wrappers_return_plain_types(spark):
    for wrap in (_web, _store):
        df = wrap(lambda s: s.orders)(spark, SF)
        assert "decimal" not in dict(df.dtypes).values()
