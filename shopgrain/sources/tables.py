"""The logical tables as a unit, with readers, views and export."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from shopgrain import schemas
from shopgrain.operators.keys import first_per_key


class Shop:
    """The six logical tables. A table is looked up when it is first used."""

    def __init__(self, load: Callable[[str], DataFrame]) -> None:
        self._load = cache(load)

    @property
    def sessions(self) -> DataFrame:
        return self._load("website_sessions")

    @property
    def pageviews(self) -> DataFrame:
        return self._load("website_pageviews")

    @property
    def orders(self) -> DataFrame:
        return self._load("orders")

    @property
    def order_items(self) -> DataFrame:
        return self._load("order_items")

    @property
    def refunds(self) -> DataFrame:
        return self._load("order_item_refunds")

    @property
    def products(self) -> DataFrame:
        return self._load("products")

    def named(self) -> dict[str, DataFrame]:
        """Stored table name -> DataFrame, in the usual listing order."""
        return {name: self._load(name) for name in schemas.TABLES}

    def register_views(self) -> None:
        """Make the tables available to ``spark.sql``."""
        for name, df in self.named().items():
            df.createOrReplaceTempView(name)


# An empty text and no text are told apart, and outer blanks stay.
_CSV = {
    "header": True,
    "nullValue": "\\N",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def read_table(spark: SparkSession, folder: str, name: str, fmt: str = "parquet") -> DataFrame:
    """One stored table with its declared schema (parquet, orc, csv or json)."""
    reader = spark.read.schema(schemas.TABLES[name])
    if fmt == "csv":
        reader = reader.options(**_CSV)
    return reader.format(fmt).load(f"{folder.rstrip('/')}/{name}")


def read_shop(spark: SparkSession, folder: str, fmt: str = "parquet", unique: bool = False) -> Shop:
    """All six tables below one folder; a row whose key is already there is skipped.

    A folder that ``shopgrain.sources.loaded.load`` has written went through the load rule
    once and is read as it lies. For any other folder the rule is applied in each query,
    which moves every table; ``unique`` leaves it out where the keys are known to be.
    """
    from shopgrain.sources import loaded

    if loaded.is_loaded(spark, folder):
        return loaded.open_shop(spark, folder)

    def load(name: str) -> DataFrame:
        df = read_table(spark, folder, name, fmt)
        return df if unique else load_once(df, [schemas.KEYS[name]])

    return Shop(load)


def load_once(df: DataFrame, keys: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """Load rule for keyed tables: a row whose key is already there is skipped."""
    return first_per_key(df, keys, order_by)


def preview(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """The first n rows in key order."""
    return df.orderBy(*order_by).limit(n)


def export(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Write a result for a dashboard; CSV gets a header line."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.options(**_CSV)
    writer.format(fmt).save(path)
