"""A stored baseline: one profile per day, updated as rows arrive, compared per weekday.

``update`` adds the rows of a delivery to a profile table. The table holds counts, sums and
extremes per day and delivery, which add up, so a delivery touches nothing that is stored,
days may come in parts, and a delivery that is written again replaces itself. ``daily``
adds them up: a row per day, whatever the number of rows profiled.

``compare`` holds each day against the days of the same weekday before it. All it reads is
the profile table, never the rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shopgrain.functions.metrics import pct, ratio, tally

METRICS = ("n_rows", "null_price_pct", "avg_price", "min_price", "max_price")

_SCHEMA = (
    "day date, n_rows bigint, n_null_price bigint, n_priced bigint, "
    "price_sum decimal(38,2), min_price decimal(18,2), max_price decimal(18,2), delivery string"
)


def update(df: DataFrame, folder: str, delivery: str, price: str = "price_usd", ts: str = "created_at") -> None:
    """Profiles the rows of one delivery per day; rows without a time form a day of their own."""
    value = F.col(price).cast("decimal(18,2)")
    per_day = df.groupBy(F.to_date(ts).alias("day")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        tally(F.col(price).isNull()).alias("n_null_price"),
        tally(F.col(price).isNotNull()).alias("n_priced"),
        F.sum(value).cast("decimal(38,2)").alias("price_sum"),
        F.min(value).alias("min_price"),
        F.max(value).alias("max_price"),
    )
    # As many rows as the delivery has days.
    per_day.coalesce(1).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/delivery={delivery}")


def daily(spark: SparkSession, folder: str) -> DataFrame:
    """One profile per day over all deliveries."""
    parts = spark.read.schema(_SCHEMA).parquet(folder)
    total = parts.groupBy("day").agg(
        *(F.sum(c).alias(c) for c in ("n_rows", "n_null_price", "n_priced", "price_sum")),
        F.min("min_price").cast("double").alias("min_price"),
        F.max("max_price").cast("double").alias("max_price"),
    )
    return total.select(
        "day",
        F.col("n_rows").cast("double").alias("n_rows"),
        pct("n_null_price", "n_rows", 4).alias("null_price_pct"),
        ratio("price_sum", "n_priced", 4).alias("avg_price"),
        "min_price",
        "max_price",
    )


def compare(
    profiles: DataFrame, weeks: int = 8, least: int = 4, tolerance_pct: float = 50.0, where: Column | None = None
) -> DataFrame:
    """A row per day and metric: its value, the mean of the baseline days, and whether it is off.

    The baseline of a day are the ``weeks`` days of its weekday that come before it in the
    table. A day of fewer than ``least`` such days is not judged. A baseline of 0 flags every
    other value, a value that is missing is flagged where the baseline has one. ``where``
    chooses the days to report; their baselines may lie outside. The window holds one row
    per day, so its seven groups are as long as the calendar.
    """
    days = profiles.where(F.col("day").isNotNull()).withColumn("weekday", F.weekday("day"))
    lines = days.select(
        "day",
        "weekday",
        F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS))),
    )
    before = Window.partitionBy("weekday", "metric").orderBy("day").rowsBetween(-weeks, -1)
    usual = ratio(F.sum("value").over(before), F.count("value").over(before), 4)
    off = F.abs(F.col("value") - F.col("baseline")) > F.abs(F.col("baseline")) * (tolerance_pct / 100)
    judged = lines.withColumns({"baseline": usual, "n_days": F.count("value").over(before)})
    flagged = (F.col("n_days") >= least) & F.coalesce(off, F.lit(True))
    shown = judged.select("day", "weekday", "metric", "value", "baseline", "n_days", flagged.alias("flagged"))
    return shown if where is None else shown.where(where)
