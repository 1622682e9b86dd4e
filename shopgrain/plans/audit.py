"""Data-quality audit and validation gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopgrain.functions.metrics import pct, ratio, tally
from shopgrain.functions.text import untrimmed
from shopgrain.functions.timebucket import ALWAYS, Span
from shopgrain.operators.keys import (
    before_parent,
    first_per_key,
    orphans,
    repeated_keys,
    split_repeated,
)
from shopgrain.sources.tables import Shop


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def row_count(df: DataFrame, name: str = "row_count") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(tbl, row_count), one row per table."""
    return _union(
        [row_count(df).select(F.lit(name).alias("tbl"), "row_count") for name, df in tables.items()]
    )


def time_range(df: DataFrame, ts: str = "created_at") -> DataFrame:
    return df.agg(F.min(ts).alias("first_record"), F.max(ts).alias("last_record"))


def copies_of_key(df: DataFrame, key: str, value) -> DataFrame:
    """How often one key value occurs."""
    return df.where(F.col(key) == value).groupBy(key).agg(F.count(F.lit(1)).alias("cnt"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All key values that occur more than once, most frequent first."""
    return repeated_keys(df, keys).orderBy(F.desc("cnt"), *keys)


def null_count(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Rows with a NULL in any of the columns."""
    rule = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    return df.agg(tally(rule).alias(name))


def bad_price(price: str = "price_usd", cost: str = "cogs_usd") -> Column:
    """A price that is not positive, or a cost that eats it up."""
    return (F.col(price) <= 0) | (F.col(cost) >= F.col(price))


def bad_price_rows(df: DataFrame) -> DataFrame:
    return df.where(bad_price())


def bad_price_count(df: DataFrame, name: str = "bad_prices") -> DataFrame:
    return df.agg(tally(bad_price()).alias(name))


def early_child_count(child: DataFrame, parent: DataFrame, key: str, **names: str) -> DataFrame:
    return row_count(before_parent(child, parent, key, **names), "early_rows")


def early_pageviews(pageviews: DataFrame, sessions: DataFrame) -> DataFrame:
    """Page views stamped before their session."""
    return before_parent(pageviews, sessions, "website_session_id").select(
        "website_pageview_id",
        F.col("created_at").alias("pageview_created_at"),
        F.col("parent_created_at").alias("session_created_at"),
    )


def timely_pageviews(pageviews: DataFrame, sessions: DataFrame) -> DataFrame:
    """Page views without those stamped before their session.

    Views without a session, or without one of the times, are not early and stay.
    """
    start = sessions.select("website_session_id", F.col("created_at").alias("_start"))
    early = F.col("created_at") < F.col("_start")
    return (
        pageviews.join(start, "website_session_id", "left")
        .where(F.coalesce(~early, F.lit(True)))
        .drop("_start")
    )


def orphan_rows(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return orphans(child, parent, key)


def orphan_count(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Number of child rows without a parent.

    Children are counted per key first, so the anti join sees one row per key.
    """
    per_key = child.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return orphans(per_key, parent, key).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("orphan_rows")
    )


def sessions_per_user(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("user_id").agg(F.count(F.lit(1)).alias("session_count"))


def heavy_users(sessions: DataFrame, more_than: int = 50, top: int = 20) -> DataFrame:
    """Users with suspiciously many sessions, the busiest first."""
    return (
        sessions_per_user(sessions)
        .where(F.col("session_count") > more_than)
        .orderBy(F.desc("session_count"), "user_id")
        .limit(top)
    )


def busiest_user(sessions: DataFrame) -> DataFrame:
    return sessions_per_user(sessions).agg(
        F.max("session_count").alias("max_sessions_per_user")
    )


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct combinations as stored: case and blanks make a difference."""
    return df.select(*columns).distinct().orderBy(*columns)


TAGS = ("utm_source", "utm_campaign", "device_type")


def untrimmed_rows(df: DataFrame, columns: Sequence[str] = TAGS) -> DataFrame:
    return df.where(untrimmed(*columns))


def untrimmed_count(
    df: DataFrame, columns: Sequence[str] = TAGS, name: str = "dirty_sources"
) -> DataFrame:
    return df.agg(tally(untrimmed(*columns)).alias(name))


def _visit_figures(sessions: DataFrame, pageviews: DataFrame, key: str) -> DataFrame:
    """Figures of sessions and page views, each read once: one row.

    Sessions are brought to (key, time), which leaves one row of most keys, and meet the
    views there. Early views count for each session row they are early for; all views of
    a key count once, however many times the key has.
    """
    n = F.count(F.lit(1))
    visits = sessions.groupBy(key, F.col("created_at").alias("started")).agg(
        n.alias("n"), tally(untrimmed(*TAGS)).alias("tags"), tally(untrimmed("http_referer")).alias("referers")
    )
    views = pageviews.select(F.col(key).alias("_of"), F.col("created_at").alias("_seen"))
    met = visits.join(views, F.col(key) == F.col("_of"), "full_outer").withColumn(
        "_is_view", F.col("_of").isNotNull() | F.col("n").isNull()
    )
    per_time = met.groupBy(key, "started").agg(
        F.max("n").alias("n"),
        F.max("tags").alias("tags"),
        F.max("referers").alias("referers"),
        tally(F.col("_is_view")).alias("views"),
        tally(F.col("_seen") < F.col("started")).alias("early"),
    )
    # Views without a session have no key here, as sessions without one.
    per_key = per_time.groupBy(key).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("sessions"),
        F.max("views").alias("views"),
        F.sum(F.col("early") * F.coalesce("n", F.lit(0))).alias("early"),
        F.sum("tags").alias("tags"),
        F.sum("referers").alias("referers"),
    )
    extra = F.greatest(F.col("sessions") - 1, F.lit(0))
    return per_key.agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("sessions", "views", "early", "tags", "referers")),
        F.coalesce(F.sum(extra), F.lit(0)).alias("extra"),
    )


def _line_figures(items: DataFrame, products: DataFrame) -> DataFrame:
    """Figures of order lines and products, each read once: one row."""
    lines = items.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
    known = products.groupBy(F.col("product_id").alias("_known")).agg(F.count(F.lit(1)).alias("n_products"))
    orphan = F.when(F.col("n_products").isNull(), F.col("n"))
    met = lines.join(known, F.col("product_id") == F.col("_known"), "full_outer")
    return met.agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "n_products")),
        F.coalesce(F.sum(orphan), F.lit(0)).alias("orphans"),
    )


def _listed(figures: DataFrame, rows: Column, *found: tuple[str, Column, str]) -> DataFrame:
    """(issue, records, action, rows) from one row of figures; ``rows`` stands in the first."""
    lines = [
        F.struct(
            F.lit(issue).alias("issue"),
            records.cast("long").alias("records"),
            F.lit(action).alias("action"),
            (rows if not i else F.lit(0)).cast("long").alias("rows"),
        )
        for i, (issue, records, action) in enumerate(found)
    ]
    return figures.select(F.inline(F.array(*lines)))


def exclusion_summary(shop: Shop, session_key: str = "website_session_id") -> DataFrame:
    """What the audit found: issue, records, share of all rows, action.

    Every table is read once, and its number of rows comes with its figures.
    """
    c = F.col
    n = F.count(F.lit(1)).alias("n")
    parts = [
        _listed(
            _visit_figures(shop.sessions, shop.pageviews, session_key),
            c("sessions") + c("views"),
            ("duplicate sessions", c("extra"), "excluded at load"),
            ("early page views", c("early"), "excluded from funnels"),
            ("untrimmed tags", c("tags"), "corrected when read"),
            ("untrimmed referers", c("referers"), "corrected when read"),
        ),
        _listed(
            shop.orders.agg(n, tally(bad_price()).alias("bad")),
            c("n"),
            ("bad price orders", c("bad"), "excluded from revenue"),
        ),
        _listed(
            _line_figures(shop.order_items, shop.products),
            c("n") + c("n_products"),
            ("orphan order items", c("orphans"), "excluded from product reports"),
        ),
        shop.refunds.agg(n).select(
            F.lit(None).cast("string").alias("issue"), F.lit(0).cast("long").alias("records"),
            F.lit(None).cast("string").alias("action"), c("n").alias("rows"),
        ),
    ]
    # Seven rows; their sum is the number of rows of all tables.
    listed = _union(parts).withColumn("_all", F.sum("rows").over(Window.partitionBy(F.lit(1))))
    return listed.where(c("issue").isNotNull()).select(
        "issue", "records", pct(c("records"), c("_all"), 4).alias("share_pct"), "action"
    )


# --- validation gates -------------------------------------------------------


def cleaned_tags(df: DataFrame, columns: Sequence[str] = TAGS) -> DataFrame:
    """Tags normalised for good, as a load step."""
    return df.withColumns({c: F.lower(F.trim(F.col(c))) for c in columns if c in df.columns})


def intake(
    df: DataFrame, keys: Sequence[str], price: str = "price_usd", order_by: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Gate at ingestion: (accepted rows, reject log).

    A row is rejected for a price that is not positive, or because its key is
    already taken by an earlier row. The log has one row per key and reason
    with the number of rows it stands for, so copies of a hot key stay small.
    """
    bad = F.col(price) <= 0
    good = df.where(F.coalesce(~bad, F.lit(True)))
    accepted = first_per_key(good, keys, order_by)
    log = F.count(F.lit(1)).alias("n_rows")
    priced_out = df.where(bad).groupBy(*keys).agg(log).withColumn("reason", F.lit("bad_price"))
    taken = (
        repeated_keys(good, keys, "n_rows")
        .withColumn("n_rows", F.col("n_rows") - 1)
        .withColumn("reason", F.lit("key_exists"))
    )
    return accepted, priced_out.unionByName(taken)


def quarantine(
    df: DataFrame, keys: Sequence[str] = ("user_id", "created_at")
) -> tuple[DataFrame, DataFrame]:
    """Gate at load: (rows to load, rows sharing user and timestamp with another)."""
    return split_repeated(df, keys)


def profile(df: DataFrame, price: str = "price_usd", ts: str = "created_at", span: Span = ALWAYS) -> DataFrame:
    """Gate at analysis: one row of figures to hold against a baseline.

    Rows are also given per day of the time they cover, so that windows of unequal
    length can be compared.
    """
    n = F.count(F.lit(1))
    days = F.datediff(F.max(ts), F.min(ts)) + 1
    return df.where(span.holds(ts)).agg(
        n.cast("double").alias("row_count"),
        ratio(n, days, 4).alias("rows_per_day"),
        pct(tally(F.col(price).isNull()), n, 4).alias("null_price_pct"),
        pct(tally(F.col(ts).isNull()), n, 4).alias("null_time_pct"),
        F.min(price).cast("double").alias("min_price"),
        F.max(price).cast("double").alias("max_price"),
    )


METRICS = ("row_count", "rows_per_day", "null_price_pct", "null_time_pct", "min_price", "max_price")


def deviations(current: DataFrame, baseline: DataFrame, tolerance_pct: float = 10.0) -> DataFrame:
    """Both profiles side by side; flagged where they differ by more than the tolerance.

    A baseline of 0 flags every other value. Each side is one row of figures. The number
    of rows is for information: their rate per day is what may be flagged.
    """

    def tall(df: DataFrame, name: str) -> DataFrame:
        return df.unpivot([], list(METRICS), "metric", name)

    off = F.abs(F.col("current_value") - F.col("baseline_value"))
    allowed = F.abs(F.col("baseline_value")) * (tolerance_pct / 100)
    return (
        tall(current, "current_value")
        .join(tall(baseline, "baseline_value"), "metric")
        .withColumn("flagged", (F.col("metric") != "row_count") & F.coalesce(off > allowed, F.lit(True)))
        .orderBy("metric")
    )
