"""The load rule, paid once: a shop's tables stored in a layout that the analyses join in.

``load`` takes rows of a shop (a first delivery or later ones), skips each row whose key is
already there, and appends the rest to bucketed parquet tables. What repeats is found from
the key column alone; whole rows are moved once, to the bucket they are stored in, and only
the rows of keys that repeat within a delivery are compared with each other.

``open_shop`` gives the stored tables as a :class:`~shopgrain.sources.tables.Shop`. They need
no load rule any more, so date windows and column choices reach the scan. Tables that are
joined lie in the same buckets: sessions, page views and orders by session; lines, and a
second copy of the orders, by order; refunds by line. Counting per session or order, and
joining on it, needs no exchange. Within a bucket file rows are ordered by time, so a date
window also skips row groups.

A bucket is read by one task. Where one session or order holds a large part of all rows,
``open_shop(..., bucketed=False)`` reads the same files as plain tables, whose hot keys the
adaptive joins split.

Null keys are one key, as in ``load_once``. An empty delivery leaves the tables as they are.
A delivery that failed half-way is loaded again: rows that arrived are skipped. Two loads of
one folder must not run at the same time.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopgrain import schemas
from shopgrain.operators.keys import first_per_key, repeated_keys
from shopgrain.session import exists, stored
from shopgrain.sources.tables import Shop

# Stored table -> (logical table, column of its buckets).
LAYOUT = {
    "website_sessions": ("website_sessions", "website_session_id"),
    "website_pageviews": ("website_pageviews", "website_session_id"),
    "orders": ("orders", "website_session_id"),
    "orders_by_id": ("orders", "order_id"),
    "order_items": ("order_items", "order_id"),
    "order_item_refunds": ("order_item_refunds", "order_item_id"),
    "products": ("products", "product_id"),
}
_SPEC = "_layout"


class LoadedShop(Shop):
    """The stored tables; ``orders_by_id`` are the orders as they lie next to their lines."""

    @property
    def orders_by_id(self) -> DataFrame:
        return self._load("orders_by_id")


def is_loaded(spark: SparkSession, folder: str) -> bool:
    """Whether ``load`` has written to this folder."""
    return exists(spark, f"{folder.rstrip('/')}/{_SPEC}")


def _name(folder: str, table: str) -> str:
    return f"shop_{sha256(folder.rstrip('/').encode()).hexdigest()[:12]}_{table}"


def _attach(spark: SparkSession, folder: str, table: str, buckets: int) -> str:
    """Makes a stored table known to the session's catalog, with its buckets."""
    logical, column = LAYOUT[table]
    schema = schemas.TABLES[logical]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    order = "SORTED BY (created_at) " if "created_at" in schema.names else ""
    name = _name(folder, table)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({fields}) USING parquet "
        f"CLUSTERED BY ({column}) {order}INTO {buckets} BUCKETS LOCATION '{folder.rstrip('/')}/{table}'"
    )
    return name


def _matches(df: DataFrame, marks: DataFrame, key: str, how: str) -> DataFrame:
    named = marks.select(F.col(key).alias("_marked"))
    return df.join(named, F.col(key).eqNullSafe(F.col("_marked")), how)


def unique_rows(df: DataFrame, key: str, order_by: Sequence[str] = ()) -> DataFrame:
    """The rows of ``load_once``, with whole rows compared only where a key repeats."""
    marks = stored(repeated_keys(df.select(key), [key]).select(key), "repeated-keys")
    if marks.isEmpty():
        return df
    single = _matches(df, marks, key, "left_anti")
    return single.unionByName(first_per_key(_matches(df, marks, key, "left_semi"), [key], order_by))


def load(source: Shop, folder: str, buckets: int = 64, tables: Sequence[str] = tuple(schemas.TABLES)) -> None:
    """Adds a delivery to the stored shop; ``buckets`` counts for the first one.

    ``source`` is read a few times, its key columns most often, so it should be files or
    a written table.
    """
    spark = next(iter(source.named().values())).sparkSession
    if is_loaded(spark, folder):
        buckets = _buckets(spark, folder)
    else:
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{folder.rstrip('/')}/{_SPEC}")
    names = {table: _attach(spark, folder, table, buckets) for table in LAYOUT}
    for logical in tables:
        key = schemas.KEYS[logical]
        copies = [t for t, (of, _) in LAYOUT.items() if of == logical]
        fresh = unique_rows(source.named()[logical], key)
        # Written once, as the rows must be the same in both copies of the orders.
        fresh = stored(fresh, "delivery") if len(copies) > 1 else fresh
        for table in copies:
            column = LAYOUT[table][1]
            new = _matches(fresh, spark.table(names[table]), key, "left_anti")
            columns = [F.col(f.name).cast(f.dataType) for f in schemas.TABLES[logical].fields]
            # One file for each bucket: the exchange deals rows as the buckets do.
            new.select(*columns).repartition(buckets, column).write.insertInto(names[table])


def _buckets(spark: SparkSession, folder: str) -> int:
    return spark.read.schema("buckets int").parquet(f"{folder.rstrip('/')}/{_SPEC}").first()["buckets"]


def open_shop(spark: SparkSession, folder: str, bucketed: bool = True) -> LoadedShop:
    """The stored tables of ``load``, in any session."""
    if not bucketed:
        return LoadedShop(
            lambda name: spark.read.schema(schemas.TABLES[LAYOUT[name][0]]).parquet(f"{folder.rstrip('/')}/{name}")
        )
    buckets = _buckets(spark, folder)
    return LoadedShop(lambda name: spark.table(_attach(spark, folder, name, buckets)))
