"""The physical plans keep the shape they are meant to have."""

import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from checks.registry import QUERIES
from shopgrain.operators import grain, keys
from shopgrain.plans import audit, customer
from shopgrain.sources import testbed
from tests.conftest import SF


def text(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


EXPANDS = {"v3_deviations": 2}


@pytest.mark.parametrize("key", list(QUERIES))
def test_no_expand_no_cross_join_no_python(spark, key):
    if key == "v1_intake_stream":
        pytest.skip("runs a stream while it is built")
    plan = text(QUERIES[key](spark, SF))
    # Expand turns one row of figures into several here; nowhere else is it allowed.
    assert len(re.findall(r"^\(\d+\) Expand", plan, re.M)) == EXPANDS.get(key, 0)
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEval", "BatchEvalPython"):
        assert word not in plan, f"{word} in the plan of {key}"


SESSION_GRAIN = [
    "b5_channel_split", "e1_conversion_rate", "k3_site_funnel", "x3_bounce_rate",
    "x4_weekly_routing", "l1_visit_buckets", "p1_monthly_margin", "p3_product_orders",
]


@pytest.mark.parametrize("key", SESSION_GRAIN)
def test_counting_hashes_and_does_not_sort(spark, key):
    assert "SortAggregate" not in text(QUERIES[key](spark, SF))


def test_semi_and_anti_joins(spark):
    assert "LeftSemi" in text(QUERIES["x6_after_test"](spark, SF))
    assert "LeftSemi" in text(QUERIES["x8_page_sessions"](spark, SF))
    assert "LeftAnti" in text(QUERIES["a14_orphan_rows"](spark, SF))
    assert "LeftAnti" in text(QUERIES["v2_to_load"](spark, SF))


def test_filters_and_columns_reach_the_scan(spark):
    plan = text(QUERIES["e1_conversion_rate"](spark, SF))
    assert "EqualTo(event_type,purchase)" in plan
    plan = text(QUERIES["p5_month_by_product"](spark, SF))
    assert "l_comment" not in plan and "l_tax" not in plan and "l_suppkey" not in plan
    plan = text(QUERIES["m2_attachment_matrix"](spark, SF))
    assert "GreaterThan(o_orderdate,1998-12-05T00:00)" in plan


def test_date_windows_reach_the_scan_of_stored_tables(spark, tmp_path, shop):
    shop.sessions.write.parquet(str(tmp_path / "website_sessions"))
    from shopgrain.sources.tables import read_table

    stored = read_table(spark, str(tmp_path), "website_sessions")
    plan = text(customer.visit_buckets(stored))
    assert "GreaterThanOrEqual(created_at,2014-01-01T00:00)" in plan
    assert "LessThan(created_at,2015-01-01T00:00)" in plan
    assert "ReadSchema: struct<created_at:timestamp_ntz,user_id:bigint>" in plan


def test_unused_repeat_flag_costs_no_window(spark):
    assert "Window" not in text(QUERIES["c1_monthly_mix"](spark, SF))


def test_runtime_filter_passes_below_the_pre_aggregation(spark, tmp_path):
    """Sessions in scope prune the page view scan, although views are aggregated first."""
    from shopgrain.plans import funnel

    given = testbed.web_shop(spark, SF)
    for name, df in (("s", given.sessions), ("p", given.pageviews)):
        df.write.parquet(str(tmp_path / name))
    conf = {
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        s, p = (spark.read.parquet(str(tmp_path / n)) for n in "sp")
        df = funnel.counts(s, p, testbed.DETAIL_PAGES)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Aggregate [website_session_id") < plan.index("might_contain")
        assert df.collect() == funnel.counts(
            given.sessions, given.pageviews, testbed.DETAIL_PAGES
        ).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_parent_is_split(spark):
    """A session with a third of all views is split by the adaptive skew join."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        n = 60000
        start = F.lit("2014-01-01").cast("timestamp_ntz")

        def at(seconds):
            return start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)

        views = spark.range(0, n, 1, 8).select(
            F.col("id").alias("website_pageview_id"),
            at(F.xxhash64("id") % 1000000).alias("created_at"),
            F.when(F.col("id") < n // 3, 7).otherwise(F.col("id")).alias("website_session_id"),
        )
        sessions = spark.range(n).select(
            F.col("id").alias("website_session_id"), at(F.col("id") % 2).alias("created_at")
        )
        # Hot views belong to session 7, which starts at second 1.
        late = F.when(F.col("id") < n // 3, 1).otherwise(F.col("id") % 2)
        expected = spark.range(n).where(F.xxhash64("id") % 1000000 < late).count()
        early = audit.early_child_count(views, sessions, "website_session_id")
        assert early.collect()[0][0] == expected > 0
        plan = early._jdf.queryExecution().executedPlan().toString()
        assert "isSkew" in plan or "skew=true" in plan
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_keys_are_combined_before_the_shuffle(spark):
    """One order, item and session hold most rows; a task still gets few of them."""
    n = 50000
    hot = spark.range(0, n, 1, 4).select(
        F.lit(1).cast("bigint").alias("order_id"),
        (F.col("id") % 5).alias("product_id"),
        F.lit(0).alias("is_primary_item"),
        F.lit(1).cast("decimal(18,2)").alias("price_usd"),
        F.lit(0).cast("decimal(18,2)").alias("cogs_usd"),
    )
    got = grain.lines_per_order(hot).collect()
    assert [(r["n_lines"], float(r["item_revenue"])) for r in got] == [(n, float(n))]
    plan = text(grain.lines_per_order(hot))
    assert plan.index("partial_count") < plan.rindex("Exchange")
    first = keys.first_per_key(hot, ["order_id"], ["product_id"])
    assert first.count() == 1 and "Window" not in text(first)


def test_audit_reads_each_table_once(spark, tmp_path, shop):
    from shopgrain.sources.tables import read_shop

    for name, df in shop.named().items():
        df.write.parquet(str(tmp_path / name))
    found = audit.exclusion_summary(read_shop(spark, str(tmp_path), unique=True))
    plan = text(found)
    for name in shop.named():
        assert len(re.findall(rf"Location: .*/{name}\]", plan)) == 1, name
    want = {r["issue"]: r["records"] for r in audit.exclusion_summary(shop).collect()}
    assert {r["issue"]: r["records"] for r in found.collect()} == want and sum(want.values()) > 5


def test_audit_of_repeated_and_missing_keys(spark, shop):
    """Figures of the summary where sessions repeat with other times, and views have none."""
    from shopgrain.sources.tables import Shop

    later = shop.sessions.where("website_session_id in (3, 13)").withColumn("created_at", F.lit("2015-01-01").cast("timestamp_ntz"))
    lost = shop.pageviews.limit(3).withColumn("website_session_id", F.expr("if(website_pageview_id % 2 = 0, 999, null)"))
    frames = {**shop.named(), "website_sessions": shop.sessions.unionByName(later).unionByName(shop.sessions.limit(2))}
    frames["website_pageviews"] = shop.pageviews.unionByName(lost)
    other = Shop(frames.__getitem__)
    got = {r["issue"]: r["records"] for r in audit.exclusion_summary(other).collect()}
    assert got["duplicate sessions"] == 4
    early = audit.early_child_count(other.pageviews, other.sessions, "website_session_id").first()[0]
    assert got["early page views"] == early > 1
    assert got["untrimmed tags"] == audit.untrimmed_count(other.sessions).first()[0]
    bad = {r["issue"]: r["share_pct"] for r in audit.exclusion_summary(other).collect()}["bad price orders"]
    n_rows = sum(df.count() for df in other.named().values())
    assert bad == pytest.approx(100 * got["bad price orders"] / n_rows, abs=1e-4)


def test_repeat_buyers_and_days_to_return_hash(spark):
    assert "SortAggregate" not in text(QUERIES["l6_repeat_buyers"](spark, SF))
    sessions = spark.read.schema("created_at timestamp_ntz, user_id long").parquet(f"{SF}/events.parquet")
    assert "Window" not in text(customer.days_to_return(sessions))


LINE_FACT = ("p5_month_by_product", "p10_lifetime_summary", "p8_monthly_refunds")


@pytest.mark.parametrize("key", LINE_FACT)
def test_one_exchange_of_lines_by_order(spark, key):
    """It serves the join with the orders and the grouping by (order, product)."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = re.findall(r"Exchange hashpartitioning\((\w+)#\d+L?, ", plan)
    # Lines and orders by order; lines and refunds by item where there are refunds.
    assert dealt.count("order_id") == 2
    assert dealt.count("order_item_id") == (0 if key.startswith("p5") else 2)
    assert not re.findall(r"hashpartitioning\(order_id#\d+L?, product_id", plan)


BY_ORDER_AND_PRODUCT = (
    "p5_month_by_product", "p10_lifetime_summary", "p10_lifetime_summary_grain_safe", "z3_net_margin",
    "g3_copies_p5_month_by_product", "g3_copies_p10_lifetime_summary",
)


@pytest.mark.parametrize("key", BY_ORDER_AND_PRODUCT)
def test_lines_are_grouped_in_little_memory(spark, key):
    """Lines are not sorted for their order, and no decimal is kept per (order, product)."""
    plan = text(QUERIES[key](spark, SF))
    assert re.search(r"ShuffledHashJoin\n.*order_id", plan)
    grouped = re.findall(r"HashAggregate\nInput .*\nKeys [^\n]*order_id#[^\n]*product_id#.*\n(?:.+\n)*", plan)
    assert grouped and not any("isEmpty" in node for node in grouped)


def test_money_of_an_order_is_exact(spark):
    """The largest prices, many to an order, negative ones and lines without a cost."""
    from shopgrain.plans import product

    top = Decimal("9999999999999999.99")
    lines = [(7, 1, top, Decimal("0.01"))] * 30 + [(7, 1, -top, None), (8, 1, Decimal("-0.03"), Decimal("0.05")), (8, 2, None, None)]
    given = [(i, *line) for i, line in enumerate(lines)]
    items = spark.createDataFrame(given, "order_item_id long, order_id long, product_id long, price_usd decimal(18,2), cogs_usd decimal(18,2)")
    day = F.lit("2014-03-01").cast("timestamp_ntz").alias("created_at")
    orders = items.select("order_id", F.lit(1).cast("decimal(18,2)").alias("price_usd"), day).distinct()
    products = spark.createDataFrame([(1, "a"), (2, "b")], "product_id long, product_name string")
    refunds = spark.createDataFrame([(1, 0), (2, 0), (3, 32)], "order_item_refund_id long, order_item_id long")
    revenue, margin = 29 * top - Decimal("0.03"), 30 * (top - Decimal("0.01")) - Decimal("0.08")
    for frame in (items, items.withColumns({c: F.col(c).cast("decimal(28,4)") for c in ("price_usd", "cogs_usd")})):
        got = product.monthly_by_product(orders, frame, products).collect()
        assert [(r["product_id"], r["orders"], r["revenue"], r["margin"]) for r in got] == [(1, 2, revenue, margin), (2, 1, None, None)]
        got = product.lifetime_summary(orders, frame, refunds, products).where("product_id = 1").first()
        assert (got["lifetime_revenue"], got["lifetime_margin"]) == (revenue + top, margin + top - Decimal("0.01"))


def test_hot_order_is_split_before_it_is_grouped(spark):
    """An order with a third of all lines: its lines are joined in several tasks."""
    from shopgrain.plans import product

    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        n = 60000
        order = F.when(F.col("id") < n // 3, 7).otherwise(F.col("id")).cast("long")
        money = F.lit(2).cast("decimal(18,2)")
        items = spark.range(0, n, 1, 8).select(
            F.col("id").alias("order_item_id"), order.alias("order_id"), (F.col("id") % 3).alias("product_id"),
            # Spread values, so that the parts do not shrink to nothing when compressed.
            (F.abs(F.xxhash64("id")) % 100000).cast("decimal(18,2)").alias("price_usd"), money.alias("cogs_usd"),
        )
        orders = spark.range(n).select(
            F.col("id").alias("order_id"), F.lit("2014-03-01").cast("timestamp_ntz").alias("created_at"), money.alias("price_usd")
        )
        products = spark.range(3).select(F.col("id").alias("product_id"), F.col("id").cast("string").alias("product_name"))
        report = product.monthly_by_product(orders, items, products)
        got = {r["product_id"]: (r["orders"], r["revenue"]) for r in report.collect()}
        sums = {r["product_id"]: r["s"] for r in items.groupBy("product_id").agg(F.sum("price_usd").alias("s")).collect()}
        assert got == {p: (sum(i % 3 == p for i in range(n // 3, n)) + 1, sums[p]) for p in range(3)}
        plan = report._jdf.queryExecution().executedPlan().toString()
        assert "isSkew" in plan or "skew=true" in plan
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_testbed_shape(spark):
    s = testbed.web_shop(spark, SF)
    assert s.pageviews.count() == 1000
    assert s.sessions.select("website_session_id").distinct().count() == s.sessions.count()
