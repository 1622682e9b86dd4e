"""The most frequent keys of a table of counts, without sorting all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from shopgrain.session import stored


def most_frequent(counted: DataFrame, key: str, limit: int, by: str | None = None) -> list[Row]:
    """Up to ``limit`` rows (by, key, n) with the largest ``n``, for each value of ``by``.

    A histogram of the counts (eight steps to a doubling, so a few hundred rows per value
    of ``by``) tells how large ``n`` must be; only rows from that step on are ranked, and
    no more than about ``limit`` per value of ``by`` are sent anywhere. Ties by the key.
    """
    groups = [] if by is None else [by]
    level = F.floor(F.log2("n") * 8).cast("int")
    rows = stored(counted.withColumn("_level", level), "counts")
    order = Window.partitionBy(*groups).orderBy(F.desc("_level"))
    steps = rows.groupBy(*groups, "_level").agg(F.count("*").alias("_rows"))
    above = F.sum("_rows").over(order.rowsBetween(Window.unboundedPreceding, -1))
    needed = steps.withColumn("_above", F.coalesce(above, F.lit(0))).where(F.col("_above") < limit)
    floor = needed.groupBy(*groups).agg(F.min("_level").alias("_floor"))
    if by is None:
        first = floor.first()
        best = rows.where(F.col("_level") >= (first["_floor"] if first and first["_floor"] is not None else 0))
        return best.orderBy(F.desc("n"), key).limit(limit).select(key, "n").collect()
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), key))
    # One row per value of ``by``, of each of which ``limit`` rows are returned anyway.
    best = rows.join(F.broadcast(floor), by).where("_level >= _floor").withColumn("_rank", rank)
    return best.where(F.col("_rank") <= limit).select(by, key, "n").collect()
