"""Marketing channel rules.

The single predicates may overlap (a campaign tagged brand without a source is
both brand and organic), which is why reports with one column per channel use
the predicates and reports with one row per channel use :func:`label`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from shopgrain.functions.text import referer, tag

# The tags the site writes.
MAIN_SOURCE = "gsearch"
SECOND_SOURCE = "bsearch"
NONBRAND = "nonbrand"
BRAND = "brand"
EXCLUDED_SOURCE = "socialbook"


def source_is(*names: str) -> Column:
    return tag("utm_source").isin(*names)


def campaign_is(*names: str) -> Column:
    return tag("utm_campaign").isin(*names)


def device_is(name: str) -> Column:
    return tag("device_type") == name


def paid(source: str, campaign: str) -> Column:
    return source_is(source) & campaign_is(campaign)


def brand() -> Column:
    """Brand campaign of any source."""
    return campaign_is(BRAND)


def organic() -> Column:
    return F.col("utm_source").isNull() & (referer() != "")


def direct() -> Column:
    return F.col("utm_source").isNull() & (referer() == "")


def unpaid_or_brand() -> Column:
    return F.col("utm_source").isNull() | brand()


def in_scope(excluded: Sequence[str] = (EXCLUDED_SOURCE,)) -> Column:
    """Drop excluded sources but keep sessions without a source."""
    return F.col("utm_source").isNull() | ~source_is(*excluded)


def five_channels() -> dict[str, Column]:
    """Brand is one channel whatever its source."""
    return {
        "gsearch_nonbrand": paid(MAIN_SOURCE, NONBRAND),
        "bsearch_nonbrand": paid(SECOND_SOURCE, NONBRAND),
        "paid_brand": brand(),
        "organic": organic(),
        "direct": direct(),
    }


def six_channels() -> dict[str, Column]:
    """Brand is split by source, so another source's brand traffic is in none."""
    return {
        "gsearch_nonbrand": paid(MAIN_SOURCE, NONBRAND),
        "bsearch_nonbrand": paid(SECOND_SOURCE, NONBRAND),
        "gsearch_brand": paid(MAIN_SOURCE, BRAND),
        "bsearch_brand": paid(SECOND_SOURCE, BRAND),
        "organic": organic(),
        "direct": direct(),
    }


def label(channels: dict[str, Column] | None = None, rest: str = "other") -> Column:
    """First matching channel name, ``rest`` when none matches."""
    result = None
    for name, rule in (channels or five_channels()).items():
        result = F.when(rule, name) if result is None else result.when(rule, name)
    return result.otherwise(rest)
