"""Conversion funnels.

A step counts a session that viewed the page at any time; order does not
matter and steps may be skipped. The same holds for the entry page here, unlike
in the experiments, which use the first page.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopgrain.functions.channel import MAIN_SOURCE, NONBRAND, device_is, in_scope, paid
from shopgrain.functions.metrics import pct, total
from shopgrain.functions.timebucket import Span, bucket
from shopgrain.operators.grain import SESSION, page_flags, session_rows

# The site's paths outside the product pages.
PRODUCT_LIST = ("/products",)
CART = ("/cart",)
SHIPPING = ("/shipping",)
BILLING = ("/billing", "/billing-2")
THANK_YOU = ("/thank-you-for-your-order",)
LANDER = "/lander-1"


def steps(detail_pages: Sequence[str]) -> dict[str, Sequence[str]]:
    """Step name -> pages, in funnel order; the product pages depend on the shop."""
    return {
        "products": PRODUCT_LIST,
        "product_detail": tuple(detail_pages),
        "cart": CART,
        "shipping": SHIPPING,
        "billing": BILLING,
        "thankyou": THANK_YOU,
    }


def _short(step: str) -> str:
    return "detail" if step == "product_detail" else step


def entered(
    sessions: DataFrame,
    pageviews: DataFrame,
    pages: Mapping[str, Sequence[str]],
    where: Column,
    lander: str = LANDER,
) -> DataFrame:
    """Sessions in scope that viewed the lander, with their step flags."""
    flags = page_flags(pageviews, {"lander": (lander,), **pages})
    return sessions.where(where).join(flags.where(F.col("hit_lander") == 1), SESSION)


def _counts(names: Sequence[str], rule: Column | None, prefix: str) -> list[Column]:
    out = []
    for name in names:
        hit = F.col(f"hit_{name}")
        value = hit if rule is None else F.when(rule, hit).otherwise(0)
        out.append(F.sum(value).alias(f"{prefix}{name}"))
    return out


def _rates(names: Sequence[str], prefix: str, rate_prefix: str = "") -> list[Column]:
    """Each step against the step before it."""
    return [
        pct(f"{prefix}{b}", f"{prefix}{a}", 1).alias(
            f"{rate_prefix}{_short(a)}_to_{_short(b)}_pct"
        )
        for a, b in zip(names, names[1:])
    ]


def entry_scope(span: Span, source: str = MAIN_SOURCE, campaign: str = NONBRAND) -> Column:
    return paid(source, campaign) & span.holds()


def counts(
    sessions: DataFrame,
    pageviews: DataFrame,
    detail_pages: Sequence[str],
    where: Column | None = None,
    lander: str = LANDER,
    repeats: bool = False,
) -> DataFrame:
    """One row: sessions at the lander and at each of the six steps.

    With ``repeats`` the sessions may have several rows each and count once.
    """
    pages = steps(detail_pages)
    scope = entry_scope(Span("2012-08-05")) if where is None else where
    if repeats:
        sessions, scope = session_rows(sessions.where(scope)), F.lit(True)
    return entered(sessions, pageviews, pages, scope, lander).agg(
        F.count(F.lit(1)).alias("sessions_at_lander"),
        *_counts(list(pages), None, "sessions_at_"),
    )


def rates(
    sessions: DataFrame,
    pageviews: DataFrame,
    detail_pages: Sequence[str],
    where: Column | None = None,
    lander: str = LANDER,
    repeats: bool = False,
) -> DataFrame:
    """The funnel counts with the six step-to-step rates."""
    names = ["lander", *steps(detail_pages)]
    base = counts(sessions, pageviews, detail_pages, where, lander, repeats)
    return base.select("*", *_rates(names, "sessions_at_"))


def by_product_page(
    sessions: DataFrame,
    pageviews: DataFrame,
    products: Mapping[str, str],
    where: Column | None = None,
    lander: str = LANDER,
) -> DataFrame:
    """One row: the rest of the funnel for the viewers of each product page.

    ``products`` maps a column prefix to a product page. A session that viewed
    two of the pages counts for both.
    """
    scope = entry_scope(Span("2013-01-06")) if where is None else where
    tail = {"cart": CART, "shipping": SHIPPING, "billing": BILLING, "thankyou": THANK_YOU}
    pages = {**{f"page_{n}": (p,) for n, p in products.items()}, **tail}
    sums: list[Column] = []
    out: list[Column] = []
    for name in products:
        seen = F.col(f"hit_page_{name}") == 1
        sums.append(F.sum(f"hit_page_{name}").alias(f"{name}_at_detail"))
        sums += _counts(list(tail), seen, f"{name}_at_")
        names = ["detail", *tail]
        out += [F.col(f"{name}_at_{s}") for s in names]
        out += _rates(names, f"{name}_at_", f"{name}_")
    return entered(sessions, pageviews, pages, scope, lander).agg(*sums).select(*out)


def by_device(
    sessions: DataFrame,
    pageviews: DataFrame,
    detail_pages: Sequence[str],
    where: Column | None = None,
    lander: str = LANDER,
    devices: Sequence[str] = ("desktop", "mobile"),
) -> DataFrame:
    """One row: the whole funnel for each device."""
    scope = entry_scope(Span("2012-08-05")) if where is None else where
    pages = steps(detail_pages)
    names = ["lander", *pages]
    sums: list[Column] = []
    out: list[Column] = []
    for device in devices:
        rule = device_is(device)
        sums.append(F.count(F.when(rule, F.lit(1))).alias(f"{device}_at_lander"))
        sums += _counts(list(pages), rule, f"{device}_at_")
        out += [F.col(f"{device}_at_{s}") for s in names]
        out += _rates(names, f"{device}_at_", f"{device}_")
    return entered(sessions, pageviews, pages, scope, lander).agg(*sums).select(*out)


def site_funnel(
    sessions: DataFrame,
    pageviews: DataFrame,
    detail_pages: Sequence[str],
    span: Span = Span.of_year(2014),
    by: str | None = None,
) -> DataFrame:
    """Sessions of all channels and how many reached each step.

    One row for the window, or one per month or quarter with ``by``.
    """
    pages = steps(detail_pages)
    joined = sessions.where(span.holds() & in_scope()).join(
        page_flags(pageviews, pages), SESSION, "left"
    )
    return reached(joined, list(pages), by)


def reached(visits: DataFrame, names: Sequence[str], by: str | None = None) -> DataFrame:
    """The figures of :func:`site_funnel` from sessions with their step flags."""
    figures = [F.count(F.lit(1)).alias("total_sessions")] + [
        total(f"hit_{name}").alias(f"reached_{name}") for name in names
    ]
    if by is None:
        return visits.agg(*figures)
    keys = bucket(by)
    out = visits.groupBy(*keys).agg(*figures)
    return out.orderBy(*out.columns[: len(keys)])
