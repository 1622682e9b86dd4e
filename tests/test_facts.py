"""Session facts: refreshed by month, read without joins, equal to the direct reports."""

import re

import pytest
from pyspark.sql import functions as F

from checks.registry import DETAIL
from shopgrain.functions.timebucket import ALWAYS, Span
from shopgrain.operators.grain import SESSION
from shopgrain.plans import channels, facts, funnel, growth
from shopgrain.sources.tables import Shop
from tests.conftest import rows
from tests.test_plans import text


@pytest.fixture()
def folder(shop, tmp_path):
    path = str(tmp_path / "facts")
    facts.refresh(shop, path, DETAIL)
    return path


def test_reports_equal_the_direct_ones(spark, shop, folder):
    f = facts.open_facts(spark, folder)
    for span in (ALWAYS, Span("2012-06-17", "2012-08-09"), Span("2012-08-01")):
        for by in ("quarter", "month"):
            assert rows(facts.master_kpis(f, by, span)) == rows(
                growth.master_kpis(shop.sessions, shop.orders, shop.order_items, by, span)
            )
        assert rows(facts.quarterly_channels(f, span)) == rows(
            channels.quarterly_channels(shop.sessions, shop.orders, shop.order_items, span)
        )
        for by in (None, "month"):
            assert rows(facts.site_funnel(f, DETAIL, span, by)) == rows(
                funnel.site_funnel(shop.sessions, shop.pageviews, DETAIL, span, by)
            )


def test_a_month_is_refreshed_alone(spark, shop, folder):
    """Later orders reach the months that are refreshed; other months keep their rows."""
    before = {r[SESSION]: r["n_all_orders"] for r in facts.open_facts(spark, folder).collect()}
    late = shop.orders.where("order_id = 101").withColumns(
        {"order_id": F.col("order_id") + 900, SESSION: F.explode(F.array(F.lit(1), F.lit(8), F.lit(9)).cast("array<long>"))}
    )
    named = {**shop.named(), "orders": shop.orders.unionByName(late.select(*shop.orders.columns))}
    facts.refresh(Shop(named.__getitem__), folder, DETAIL, [(2012, 8)])
    after = {r[SESSION]: r["n_all_orders"] for r in facts.open_facts(spark, folder).collect()}
    assert set(after) == set(before)
    changed = {i for i in after if after[i] != before[i]}
    assert changed == {8, 9}  # session 1 began in March
    spark.catalog.refreshByPath(folder)
    assert facts.open_facts(spark, folder).count() == shop.sessions.count()


def test_reports_are_one_scan_of_the_months_in_question(spark, shop, folder):
    f = facts.open_facts(spark, folder)
    plan = text(facts.master_kpis(f, "month", Span("2012-08-01", "2012-09-01")))
    assert "Join" not in plan and len(re.findall(r"^\(\d+\) Scan", plan, re.M)) == 1
    assert "(month" in plan and "201208" in plan and "PartitionFilters: [" in plan
    assert len(re.findall(r"^\(\d+\) Exchange", plan, re.M)) == 2  # groups, and the order of the report
