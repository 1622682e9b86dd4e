"""Product mix, margin, launches and refunds."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from shopgrain.functions.metrics import money, pct
from shopgrain.functions.timebucket import ALWAYS, Span, bucket, moment, period
from shopgrain.operators.grain import (
    ORPHAN_PRODUCT,
    known_product,
    lines_per_order,
    priced,
    refunds_per_item,
)
from shopgrain.plans.growth import basket_kpis

_SHORT, _HALF = 18, 32  # digits of a decimal that is a long, bits of its lower half


def monthly_margin(
    orders: DataFrame, items: DataFrame, span: Span = ALWAYS, orphan: int = ORPHAN_PRODUCT
) -> DataFrame:
    """Orders, revenue and margin per month, from order lines."""
    lines = lines_per_order(items, known_product(orphan)).where(F.col("n_kept") > 0)
    return (
        priced(orders)
        .where(span.holds())
        .select("order_id", "created_at")
        .join(lines, "order_id")
        .groupBy(*bucket("month"))
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum("item_revenue").alias("_revenue"),
            F.sum("item_margin").alias("_margin"),
        )
        .select(
            "yr",
            "mo",
            "orders",
            money("_revenue").alias("total_revenue"),
            money("_margin").alias("total_margin"),
            pct("_margin", "_revenue", 1).alias("margin_pct"),
        )
        .orderBy("yr", "mo")
    )


def monthly_efficiency(
    sessions: DataFrame,
    orders: DataFrame,
    items: DataFrame,
    span: Span = Span("2013-04-01"),
    orphan: int = ORPHAN_PRODUCT,
) -> DataFrame:
    """Conversion and line revenue per session by month; no channel is excluded."""
    return (
        basket_kpis(sessions, orders, items, bucket("month"), span.holds(), orphan)
        .select("yr", "mo", "sessions", "orders", "conv_rate_pct", "rev_per_session")
        .orderBy("yr", "mo")
    )


def monthly_product_orders(
    orders: DataFrame,
    items: DataFrame,
    products: Mapping[str, int],
    span: Span = Span("2013-04-01"),
    primary_only: bool = False,
    suffix: str = "orders",
    orphan: int = ORPHAN_PRODUCT,
) -> DataFrame:
    """Orders per month that hold each product, side by side.

    ``products`` maps a column prefix to a product id. With ``primary_only`` a
    product counts only as the first choice, which shows cannibalisation.
    """
    chosen = F.col("is_primary_item") == 1 if primary_only else F.lit(True)
    held = [
        F.max(F.when((F.col("product_id") == pid) & chosen, 1).otherwise(0)).alias(f"_has_{name}")
        for name, pid in products.items()
    ]
    per_order = items.where(known_product(orphan)).groupBy("order_id").agg(*held)
    return (
        priced(orders)
        .where(span.holds())
        .select("order_id", "created_at")
        .join(per_order, "order_id")
        .groupBy(*bucket("month"))
        .agg(
            F.count(F.lit(1)).alias("total_orders"),
            *[F.sum(f"_has_{name}").alias(f"{name}_{suffix}") for name in products],
        )
        .orderBy("yr", "mo")
    )


def launch_impact(
    sessions: DataFrame,
    orders: DataFrame,
    items: DataFrame,
    launch: str = "2013-12-12",
    span: Span = Span("2013-11-12", "2014-01-12"),
    orphan: int = ORPHAN_PRODUCT,
) -> DataFrame:
    """Session and order figures before and after a launch, inside a window."""
    half = F.when(F.col("created_at") < moment(launch), "A_before").otherwise("B_after")
    return (
        basket_kpis(sessions, orders, items, [half.alias("period")], span.holds(), orphan)
        .drop("total_revenue")
        .orderBy("period")
    )


def _scope(orders: DataFrame, repeats: bool, *keys: Column) -> tuple[DataFrame, Column | None]:
    """Priced orders with ``keys``, a row each, and how often an order's lines count."""
    if not repeats:
        return priced(orders).select("order_id", *keys), None
    rows = priced(orders).groupBy("order_id", *keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return rows, F.col("n_rows")


class _Sums:
    """Revenue and margin of lines, kept per (order, product) and added up per product.

    The grouping by (order, product) holds nearly a row for each line, so what it keeps of
    one decides the memory of a task. A short decimal is kept as two halves of its unscaled
    value, each summed as a long: 16 bytes where a decimal sum takes 32, and no sum of one
    order comes near 64 bits. Money of other types is summed as it is.
    """

    def __init__(self, items: DataFrame, times: Column | None) -> None:
        kinds = [items.schema[c].dataType for c in ("price_usd", "cogs_usd")]
        exact = all(isinstance(k, DecimalType) for k in kinds)
        self.scale = max(k.scale for k in kinds) if exact else None
        if exact and max(k.precision - k.scale for k in kinds) + self.scale > _SHORT:
            self.scale = None
        self.times = times

    def _kept(self, value: Column, name: str) -> list[Column]:
        parts = {name: value}
        if self.scale is not None:
            parts = {f"{name}_hi": F.shiftright(value, _HALF), f"{name}_lo": value.bitwiseAND(F.lit((1 << _HALF) - 1))}
        return [F.sum(v if self.times is None else v * self.times).alias(n) for n, v in parts.items()]

    def per_order(self) -> list[Column]:
        value, cost = F.col("price_usd"), F.col("cogs_usd")
        if self.scale is not None:
            value, cost = ((c * 10**self.scale).cast("long") for c in (value, cost))
        return self._kept(value, "_revenue") + self._kept(value - cost, "_margin")

    def over_orders(self) -> list[Column]:
        return [self._added(name).alias(name) for name in ("_revenue", "_margin")]

    def _added(self, name: str) -> Column:
        if self.scale is None:
            return F.sum(name)
        hi, lo = (F.sum(F.col(f"{name}_{half}").cast("decimal(20,0)")) for half in ("hi", "lo"))
        units = hi * F.lit(1 << _HALF).cast("decimal(11,0)") + lo
        return (units * F.lit(Decimal(1).scaleb(-self.scale))).cast(DecimalType(38, self.scale))


def monthly_by_product(
    orders: DataFrame,
    items: DataFrame,
    products: DataFrame,
    span: Span = ALWAYS,
    orphan: int = ORPHAN_PRODUCT,
    repeats: bool = False,
) -> DataFrame:
    """Orders, revenue and margin per month and product.

    Lines meet their order first, so one exchange of them by order serves the join and the
    grouping by (order, product) after it. Orders in scope are one short row each: they are
    hashed, and the lines of a task are not sorted. The product name is joined to the
    finished groups, so the product key of the lines is never a join key.
    """
    scope, times = _scope(orders.where(span.holds()), repeats, *bucket("month"))
    sums = _Sums(items, times)
    return (
        items.where(known_product(orphan))
        .join(scope.hint("shuffle_hash"), "order_id")
        .groupBy("order_id", "product_id", "yr", "mo")
        .agg(*sums.per_order())
        .groupBy("yr", "mo", "product_id")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            *sums.over_orders(),
        )
        .join(products.select("product_id", "product_name"), "product_id")
        .select(
            "yr",
            "mo",
            "product_id",
            "product_name",
            "orders",
            money("_revenue").alias("revenue"),
            money("_margin").alias("margin"),
            pct("_margin", "_revenue", 1).alias("margin_pct"),
        )
        .orderBy("yr", "mo", "product_id")
    )


def sold_lines(
    items: DataFrame, refunds: DataFrame, grain_safe: bool = False, orphan: int = ORPHAN_PRODUCT, where: Column | None = None
) -> DataFrame:
    """Lines with ``n_sold`` and ``n_refunded``.

    As the reports were written, a line counts once per matching refund, in the
    money too; ``grain_safe`` counts a line once and a refunded line once.
    """
    rule = known_product(orphan) if where is None else known_product(orphan) & where
    matches = F.coalesce(F.col("n_refunds"), F.lit(0))
    sold, refunded = F.greatest(matches, F.lit(1)), matches
    if grain_safe:
        sold, refunded = F.lit(1), F.when(matches > 0, 1).otherwise(0)
    return (
        items.where(rule)
        .join(refunds_per_item(refunds), "order_item_id", "left")
        .select("order_id", "product_id", "price_usd", "cogs_usd", sold.alias("n_sold"), refunded.alias("n_refunded"))
    )


def _sold_totals(times: Column | None) -> list[Column]:
    n = F.lit(1) if times is None else times
    return [F.sum(F.col("n_sold") * n).alias("items_sold"), F.sum(F.col("n_refunded") * n).alias("items_refunded")]


def monthly_refunds(
    orders: DataFrame,
    items: DataFrame,
    refunds: DataFrame,
    products: DataFrame,
    span: Span = ALWAYS,
    grain_safe: bool = False,
    orphan: int = ORPHAN_PRODUCT,
    repeats: bool = False,
) -> DataFrame:
    """Refund rate per month and product."""
    scope, times = _scope(orders.where(span.holds()), repeats, *bucket("month"))
    return (
        sold_lines(items, refunds, grain_safe, orphan)
        .join(scope, "order_id")
        .groupBy("yr", "mo", "product_id")
        .agg(*_sold_totals(times))
        .join(products.select("product_id", "product_name"), "product_id")
        .select(
            "yr",
            "mo",
            "product_id",
            "product_name",
            "items_sold",
            "items_refunded",
            pct("items_refunded", "items_sold").alias("refund_rate_pct"),
        )
        .orderBy("yr", "mo", "product_id")
    )


def refund_periods(
    orders: DataFrame,
    items: DataFrame,
    refunds: DataFrame,
    product: int = 1,
    periods: Mapping[str, Span] | None = None,
    grain_safe: bool = False,
    orphan: int = ORPHAN_PRODUCT,
    repeats: bool = False,
) -> DataFrame:
    """Refund rate of one product in named periods, as around a supplier change."""
    # Names and dates of the periods around the supplier change.
    periods = periods or {
        "A_before_new_supplier": Span("2014-06-01", "2014-09-01"),
        "B_transition_sep2014": Span("2014-09-01", "2014-10-01"),
        "C_after_new_supplier": Span("2014-10-01", "2015-01-01"),
    }
    scope, times = _scope(orders, repeats, period(dict(periods)).alias("period"))
    lines = sold_lines(items, refunds, grain_safe, orphan, F.col("product_id") == product)
    return (
        lines.join(scope.where(F.col("period").isNotNull()), "order_id")
        .groupBy("period")
        .agg(*_sold_totals(times))
        .withColumn("refund_rate_pct", pct("items_refunded", "items_sold"))
        .orderBy("period")
    )


def lifetime_summary(
    orders: DataFrame,
    items: DataFrame,
    refunds: DataFrame,
    products: DataFrame,
    grain_safe: bool = False,
    orphan: int = ORPHAN_PRODUCT,
    repeats: bool = False,
) -> DataFrame:
    """Orders, revenue, margin and refund rate per product over all time.

    As in :func:`monthly_by_product`, (order, product) is grouped where the lines meet
    their order.
    """
    scope, copies = _scope(orders, repeats)
    sums = _Sums(items, F.col("n_sold") if copies is None else F.col("n_sold") * copies)
    return (
        sold_lines(items, refunds, grain_safe, orphan)
        .join(scope.hint("shuffle_hash"), "order_id")
        .groupBy("order_id", "product_id")
        .agg(*sums.per_order(), *_sold_totals(copies))
        .groupBy("product_id")
        .agg(
            F.count(F.lit(1)).alias("lifetime_orders"),
            *sums.over_orders(),
            F.sum("items_sold").alias("_sold"),
            F.sum("items_refunded").alias("_refunded"),
        )
        .join(products.select("product_id", "product_name"), "product_id")
        .select(
            "product_id",
            "product_name",
            "lifetime_orders",
            money("_revenue").alias("lifetime_revenue"),
            money("_margin").alias("lifetime_margin"),
            pct("_margin", "_revenue", 1).alias("margin_pct"),
            pct("_refunded", "_sold").alias("lifetime_refund_rate_pct"),
        )
        .orderBy(F.desc("lifetime_revenue"), "product_id")
    )


def net_margin(summary: DataFrame) -> DataFrame:
    """Margin after the refund haircut, from :func:`lifetime_summary`."""
    keep = 1 - F.col("lifetime_refund_rate_pct") / 100
    return summary.select(
        "product_id",
        "product_name",
        "margin_pct",
        "lifetime_refund_rate_pct",
        F.round(F.col("margin_pct") * keep, 1).alias("net_margin_pct"),
    ).orderBy(F.desc("net_margin_pct"), "product_id")
