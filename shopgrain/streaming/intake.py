"""Ingestion gate on a stream: tags normalised, rejects logged with their reason.

Two queries, one after the other. The first looks at a batch alone: prices, rows that are
late against the clock so far, and copies inside the batch, which an aggregation combines
before the shuffle, so a hot key reaches the next step as one row. The second remembers
keys in the state store, one small entry per accepted key: where its first row came. It is
Spark's own aggregation, without a call per key. Rows that came elsewhere have a key of an
earlier batch. Neither reads what earlier batches wrote (of the clock and of the batches
judged, the last value), so a batch costs what its own rows cost, however long the stream
has run.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopgrain.plans.audit import cleaned_tags
from shopgrain.session import make_folder, work_folder

REASONS = ("bad_price", "late", "key_exists")


@dataclass(frozen=True)
class IntakeRun:
    """Folders written so far. ``accepted`` and ``rejected`` hold every row of the input
    once; ``progress`` has one row per batch (the latest event time so far, number of rows)."""

    accepted: str
    rejected: str
    progress: str


def _alone(run: IntakeRun, base: str, keys: Sequence[str], price: str, event_time: str, delay: str):
    """The work on one batch by itself. Each folder of a batch is replaced as a whole, so a
    batch that is run again after a failure neither loses nor repeats rows."""

    def load(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stage = f"{base}/_staged/batch={number}"
        cleaned_tags(batch).withColumn("_row", F.monotonically_increasing_id()).write.mode("overwrite").parquet(stage)
        rows = spark.read.parquet(stage)
        latest = None
        if number:
            latest = spark.read.schema("latest timestamp_ntz").parquet(f"{run.progress}/batch={number - 1}").first()[0]
        late = F.lit(False)
        if latest is not None:
            late = F.col(event_time) < F.lit(latest).cast("timestamp_ntz") - F.expr(f"interval {delay}")
        reason = F.when(F.col(price) <= 0, "bad_price").when(late, "late")
        good = rows.where(reason.isNull())
        first = good.groupBy(*keys).agg(F.min(F.struct(event_time, "_row")).alias("first"))
        ahead = f"{base}/_first/batch={number}"
        good.join(first.select("first._row"), "_row", "left_semi").write.mode("overwrite").parquet(ahead)
        rest = rows.join(spark.read.parquet(ahead).select("_row"), "_row", "left_anti")
        rest = rest.withColumn("reason", F.coalesce(reason, F.lit("key_exists")))
        rest.write.mode("overwrite").parquet(f"{run.rejected}/step=1/batch={number}")
        so_far = F.greatest(F.max(event_time).cast("timestamp_ntz"), F.lit(latest).cast("timestamp_ntz"))
        figures = rows.agg(so_far.alias("latest"), F.count(F.lit(1)).alias("n_rows"))
        figures.write.mode("overwrite").parquet(f"{run.progress}/batch={number}")

    return load


_FIRST = "_batch long, _row long, last long"


def _judged(run: IntakeRun, base: str):
    """Accepted rows and those whose key had come before.

    ``firsts`` has a row for each key of the new batches: where its first row ever came, and
    the last batch that brought it. As all that lies ahead is taken at once, in order, the
    new batches are those after the last one judged before.
    """

    def load(firsts: DataFrame, number: int) -> None:
        spark = firsts.sparkSession
        kept, done = f"{base}/_verdicts/batch={number}", f"{base}/_judged/batch="
        firsts.write.mode("overwrite").parquet(kept)
        first = spark.read.schema(_FIRST).parquet(kept)
        before = spark.read.schema("last long").parquet(f"{done}{number - 1}").first()[0] if number else -1
        last = first.agg(F.coalesce(F.max("last"), F.lit(before)).cast("long").alias("last")).first()[0]
        spark.range(1).select(F.lit(last).cast("long").alias("last")).write.mode("overwrite").parquet(f"{done}{number}")
        if last == before:
            return
        new = [f"{base}/_first/batch={n}" for n in range(before + 1, last + 1)]
        rows = spark.read.option("basePath", f"{base}/_first").parquet(*new)
        rows = rows.withColumnRenamed("batch", "_batch").withColumn("_batch", F.col("_batch").cast("long"))
        place = ["_batch", "_row"]
        fresh = rows.join(first.select(*place), place, "left_semi").drop("_batch")
        fresh.write.mode("overwrite").parquet(f"{run.accepted}/batch={number}")
        again = rows.join(first.select(*place), place, "left_anti").drop("_batch").withColumn("reason", F.lit("key_exists"))
        again.write.mode("overwrite").parquet(f"{run.rejected}/step=2/batch={number}")

    return load


def run_intake(
    spark: SparkSession,
    rows: DataFrame,
    keys: Sequence[str],
    price: str = "price_usd",
    event_time: str = "created_at",
    delay: str = "1 hour",
    folder: str | None = None,
) -> IntakeRun:
    """Process everything that is there, then stop; all outputs are parquet.

    A row is rejected for a price that is not positive, as late if its event time is more
    than ``delay`` before the latest one of earlier batches, or because its key was
    accepted before. A missing price or time passes. Null keys are one key. Tags are
    normalised first.
    """
    base = folder or work_folder(spark, "intake")
    run = IntakeRun(f"{base}/accepted", f"{base}/rejected", f"{base}/progress")
    alone = rows.writeStream.foreachBatch(_alone(run, base, keys, price, event_time, delay))
    alone.option("checkpointLocation", f"{base}/_state").trigger(availableNow=True).start().awaitTermination()
    make_folder(spark, f"{base}/_first")  # nothing may have come yet
    schema = cleaned_tags(rows).schema.add("_row", "long").add("batch", "long")
    ahead = spark.readStream.schema(schema).parquet(f"{base}/_first").withColumnRenamed("batch", "_batch")
    # A key has one row in a batch at most, so the least batch tells the row.
    firsts = (
        ahead.select(*keys, "_batch", "_row")
        .groupBy(*keys)
        .agg(F.min_by("_row", "_batch").alias("_row"), F.min("_batch").alias("_first"), F.max("_batch").alias("last"))
        .select(F.col("_first").alias("_batch"), "_row", "last")
    )
    judged = firsts.writeStream.foreachBatch(_judged(run, base)).outputMode("update")
    judged.option("checkpointLocation", f"{base}/_keys").trigger(availableNow=True).start().awaitTermination()
    return run
