"""Session settings and the shared work folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the plans rely on. All are ordinary Spark options; a cluster's own
# values win because they are only set when the session is created here.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Splits a hot join partition at run time: a session, order or product may
    # hold a large part of the rows of the many side.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Also where a grouping after the join would have used its partitioning: a hot order is
    # split, and its parts meet again in one more exchange, after a map-side combine.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.ansi.enabled": "true",
    # Keys of a stream are kept on disk, and a batch saves what it changed.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Page views and orders are pruned by a filter of the sessions in scope also where
    # those are more than the default of 10 MB; beyond that the filter loses precision,
    # not rows.
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "10GB",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumItems": "100000000",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumBits": "1073741824",
}


def build_session(master: str | None = None, app: str = "shopgrain", **extra: str) -> SparkSession:
    """Session with the defaults above; ``extra`` uses ``__`` for the dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder that the driver and all executors share.

    It lies below ``spark.checkpoint.dir`` or, where the session does not name
    one, below its warehouse. On a cluster a warehouse on the driver's own disk is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.sql.warehouse.dir", None
    )
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    on_cluster = not (spark.conf.get("spark.master", None) or "local").startswith("local")
    if on_cluster and not spark.conf.get("spark.checkpoint.dir", None) and base.startswith(("file:", "/")):
        raise ValueError(f"{base} is not shared by the executors: set spark.checkpoint.dir")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, folder: str):
    """The Hadoop file system of a folder, and the folder in it."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(context._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, folder: str) -> bool:
    files, path = _path(spark, folder)
    return files.exists(path)


def make_folder(spark: SparkSession, folder: str) -> None:
    files, path = _path(spark, folder)
    files.mkdirs(path)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written as Parquet below the shared folder and read again.

    Cuts the lineage and fixes the rows: what is read twice is the same twice, and
    a lost executor costs no recomputation.
    """
    path = work_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
