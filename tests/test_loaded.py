"""The stored load: rows as by the load rule, no exchange afterwards, dates at the scan."""

import re

import pytest
from pyspark.sql import functions as F

from checks.registry import DETAIL
from shopgrain import schemas
from shopgrain.functions.timebucket import Span
from shopgrain.operators import grain
from shopgrain.plans import customer, funnel, growth
from shopgrain.sources import loaded, tables, testbed
from shopgrain.sources.tables import Shop
from tests.conftest import SF, rows
from tests.test_plans import text


def same(a, b) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.fixture(scope="module")
def web(spark):
    shop = testbed.web_shop(spark, SF)
    frames = {name: df.cache() for name, df in shop.named().items()}
    return Shop(frames.__getitem__)


@pytest.fixture(scope="module")
def folder(spark, web, tmp_path_factory):
    """Loaded in two deliveries that overlap, the second with copies inside."""
    path = str(tmp_path_factory.mktemp("loaded"))
    key = {name: F.col(schemas.KEYS[name]) for name in schemas.TABLES}
    first = Shop(lambda name: web.named()[name].where(key[name] % 3 != 0))
    loaded.load(first, path, buckets=4)
    rest = Shop(lambda name: web.named()[name].unionByName(web.named()[name].where(key[name] % 5 == 0)))
    loaded.load(rest, path)
    return path


@pytest.fixture()
def settings(spark):
    """No broadcasts, so that a plan shows what would move."""
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold",)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def exchanges(df) -> int:
    return len(re.findall(r"^\(\d+\) Exchange", text(df), re.M))


def test_rows_are_those_of_the_load_rule(spark, web, folder):
    stored = loaded.open_shop(spark, folder)
    for name, df in web.named().items():
        want = tables.load_once(df, [schemas.KEYS[name]])
        got = stored.named()[name]
        assert got.columns == want.columns
        key = schemas.KEYS[name]
        assert same(got.select(key), want.select(key)), name
        if df.select(key).distinct().count() == df.count():
            assert same(got, want), name
    assert same(stored.orders, stored.orders_by_id)


def test_loading_again_adds_nothing(spark, web, folder):
    counts = [df.count() for df in loaded.open_shop(spark, folder).named().values()]
    loaded.load(web, folder, tables=["orders", "order_items"])
    loaded.load(Shop(lambda name: web.named()[name].limit(0)), folder)
    assert [df.count() for df in loaded.open_shop(spark, folder).named().values()] == counts


def test_unique_rows_equal_the_load_rule(spark):
    df = spark.createDataFrame(
        [(1, "b"), (1, "a"), (2, None), (3, "x"), (None, "n"), (None, "m"), (4, "z"), (4, "z")], "id long, x string"
    )
    assert same(loaded.unique_rows(df, "id"), tables.load_once(df, ["id"]))
    assert same(loaded.unique_rows(df.where("id = 3"), "id"), df.where("id = 3"))


def test_readers_take_the_stored_tables(spark, web, folder):
    shop = tables.read_shop(spark, folder)
    assert isinstance(shop, loaded.LoadedShop)
    plain = loaded.open_shop(spark, folder, bucketed=False)
    for df in (shop.sessions, plain.sessions):
        assert df.count() == web.sessions.count()
    for a, b in ((shop, plain), (shop, web)):
        assert rows(growth.conversion_rate(a.sessions, a.orders)) == rows(growth.conversion_rate(b.sessions, b.orders))


def test_sessions_orders_and_views_join_without_exchange(spark, folder, settings):
    shop = tables.read_shop(spark, folder)
    assert exchanges(grain.with_orders(shop.sessions, shop.orders)) == 0
    assert exchanges(shop.sessions.join(grain.page_flags(shop.pageviews, funnel.steps(DETAIL)), grain.SESSION)) == 0
    # The one that is left gathers finished groups, and one sorts the report.
    assert exchanges(growth.conversion_rate(shop.sessions, shop.orders)) == 2
    assert exchanges(growth.conversion_rate(*(loaded.open_shop(spark, folder, False).named()[t] for t in ("website_sessions", "orders")))) > 2


def test_orders_and_lines_join_without_exchange(spark, folder, settings):
    shop = tables.read_shop(spark, folder)
    lines = grain.lines_per_order(shop.order_items)
    assert exchanges(shop.orders_by_id.join(lines, "order_id", "left")) == 0
    assert exchanges(shop.order_items.join(grain.refunds_per_item(shop.refunds), "order_item_id", "left")) == 1  # the lines


def test_date_windows_reach_the_scan_of_loaded_tables(spark, folder):
    shop = tables.read_shop(spark, folder)
    plan = text(customer.visit_buckets(shop.sessions))
    assert "GreaterThanOrEqual(created_at,2014-01-01T00:00)" in plan
    assert "ReadSchema: struct<created_at:timestamp_ntz,user_id:bigint>" in plan
    span = Span("2013-01-01", "2013-02-01")
    plan = text(growth.conversion_rate(shop.sessions.where(span.holds()), shop.orders))
    assert "LessThan(created_at,2013-02-01T00:00)" in plan and "SelectedBucketsCount: 4 out of 4" in plan


def test_sessions_that_read_a_bucket_file_are_whole(spark, folder):
    """Every stored file holds keys of one bucket only, also after the second delivery."""
    from pyspark.sql.functions import input_file_name

    shop = loaded.open_shop(spark, folder, bucketed=False)
    for name, column in (("website_pageviews", grain.SESSION), ("order_items", "order_id")):
        df = shop.named()[name].select(column, F.regexp_extract(input_file_name(), r"_(\d+)\.c", 1).alias("bucket"))
        assert df.distinct().groupBy(column).count().where("count > 1").isEmpty()
