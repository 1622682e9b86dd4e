"""Opportunity and budget sizing from other reports.

Inputs are the small result tables of the other plans; figures of a one-row
table enter as scalar subqueries, not as joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopgrain.functions.metrics import over


def leak_value(
    funnel: DataFrame, order_value: DataFrame, months: float = 31.5, lift_pp: float = 10.0
) -> DataFrame:
    """Worth of a better detail-to-cart step.

    ``funnel`` is the one-row funnel with rates; ``order_value`` is one row with
    ``avg_order_value``. The orders are not rounded before they are priced.
    """
    monthly = F.round(F.col("sessions_at_product_detail") / months, 1)
    extra = F.col("avg_monthly_sessions_at_detail") * (lift_pp / 100)
    return (
        funnel.select(
            monthly.alias("avg_monthly_sessions_at_detail"),
            F.col("detail_to_cart_pct").alias("current_detail_to_cart_pct"),
            F.round(F.col("detail_to_cart_pct") + lift_pp, 1).alias("improved_detail_to_cart_pct"),
            order_value.select("avg_order_value").scalar().alias("_aov"),
        )
        .select(
            "avg_monthly_sessions_at_detail",
            "current_detail_to_cart_pct",
            "improved_detail_to_cart_pct",
            F.round(extra, 0).alias("additional_orders_per_month"),
            F.round(extra * F.col("_aov"), 2).alias("additional_revenue_per_month"),
        )
    )


def monthly_averages(baseline: DataFrame, funnel: DataFrame) -> DataFrame:
    """One row of monthly averages over a window.

    ``baseline`` is the monthly master table, ``funnel`` the monthly site funnel.
    """
    n = F.count(F.lit(1))
    base = baseline.agg(
        F.sum("sessions").alias("_sessions"),
        F.sum("orders").alias("_orders"),
        F.sum("total_revenue").alias("_revenue"),
        n.alias("_months"),
    )
    steps = funnel.agg(
        over(F.sum("reached_product_detail"), n).alias("detail"),
        over(F.sum("reached_cart"), n).alias("cart"),
        over(F.sum("reached_cart"), F.sum("reached_product_detail")).alias("detail_to_cart"),
        over(F.sum("reached_thankyou"), F.sum("reached_cart")).alias("cart_to_order"),
    )
    # One subquery for all four figures, so that the funnel is computed once.
    figures = steps.select(F.struct("*")).scalar()
    return base.withColumn("_steps", figures).select(
        over("_sessions", "_months").alias("sessions"),
        over("_orders", "_months").alias("orders"),
        over("_revenue", "_orders").alias("order_value"),
        over("_orders", "_sessions").alias("conversion"),
        over("_revenue", "_sessions").alias("revenue_per_session"),
        "_steps.*",
    )


def page_redesign(averages: DataFrame, budget: float = 40000.0, lift_pp: float = 10.0) -> DataFrame:
    """Extra orders and payback of a better product page."""
    carts = F.col("detail") * (lift_pp / 100)
    orders = carts * F.col("cart_to_order")
    revenue = orders * F.col("order_value")
    return averages.select(
        F.round(F.col("detail"), 0).alias("sessions_at_detail"),
        F.round(F.col("detail_to_cart") * 100, 1).alias("current_rate_pct"),
        F.round(carts, 0).alias("extra_carts"),
        F.round(orders, 0).alias("extra_orders"),
        F.round(revenue, 2).alias("extra_revenue"),
        F.round(budget / F.nullif(revenue, F.lit(0.0)), 1).alias("payback_months"),
        F.round(revenue * 12, 2).alias("annual_value"),
    )


def cross_sell_push(
    averages: DataFrame, unit_price: float, budget: float = 25000.0, lift_pp: float = 5.0
) -> DataFrame:
    """Extra add-ons and payback of a higher attachment rate."""
    units = F.col("orders") * (lift_pp / 100)
    revenue = units * unit_price
    return averages.select(
        F.round(F.col("orders"), 0).alias("orders_per_month"),
        F.round(units, 0).alias("extra_units"),
        F.round(revenue, 2).alias("extra_revenue"),
        F.round(budget / F.nullif(revenue, F.lit(0.0)), 1).alias("payback_months"),
    )


def paid_scale_up(
    averages: DataFrame,
    user_value: DataFrame,
    budget: float = 35000.0,
    click_costs: Sequence[float] = (0.75, 1.50),
) -> DataFrame:
    """Return of paid clicks at several click costs, and the break-even cost.

    ``user_value`` is the value-per-user table; its ratio of returned to single
    visitors scales the revenue of a session.
    """

    def worth(kind: str) -> Column:
        return F.max(F.when(F.col("user_type") == kind, F.col("avg_revenue_per_user")))

    multiple = user_value.agg(
        over(worth("Returned at least once"), worth("Single visit")).alias("m")
    ).scalar()
    visits = budget / F.col("click_cost")
    orders = visits * F.col("conversion")
    revenue = orders * F.col("order_value")
    costs = F.array(*[F.lit(float(c)) for c in click_costs])
    return (
        averages.withColumn("click_cost", F.explode(costs))
        .withColumn("_multiple", multiple)
        .select(
            "click_cost",
            F.round("_multiple", 2).alias("value_multiple"),
            F.round(F.col("revenue_per_session") * F.col("_multiple"), 2).alias("break_even_cost"),
            F.round(visits, 0).alias("sessions"),
            F.round(orders, 0).alias("orders"),
            F.round(revenue, 2).alias("revenue"),
            F.round(revenue / budget, 1).alias("return_on_spend"),
        )
        .orderBy("click_cost")
    )
