"""Key integrity: first row per key, repeated keys, missing parents."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """The first row of every key; the others are skipped.

    Order: ``order_by``, then all remaining columns, so the result does not
    depend on the file layout. It is a minimum over a struct, not a window:
    copies of a hot key are combined before the shuffle and never meet in one
    task.
    """
    rest = [c for c in df.columns if c not in keys and c not in order_by]
    ordered = [*order_by, *rest]
    if not ordered:
        return df.distinct()
    best = F.min(F.struct(*ordered)).alias("_first")
    kept = df.groupBy(*keys).agg(best)
    return kept.select(
        *[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns]
    )


def repeated_keys(df: DataFrame, keys: Sequence[str], copies: str = "cnt") -> DataFrame:
    """Key values held by more than one row, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(copies)).where(F.col(copies) > 1)


def split_repeated(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with a unique key, rows whose key occurs more than once)."""
    marks = repeated_keys(df, keys).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    cond = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)],
    )
    return df.join(marks, cond, "left_anti"), df.join(marks, cond, "left_semi")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Child rows without a parent; a NULL key has none."""
    ids = parent.select(F.col(parent_key or key).alias("_parent"))
    return child.join(ids, F.col(key) == F.col("_parent"), "left_anti")


def before_parent(
    child: DataFrame,
    parent: DataFrame,
    key: str,
    parent_key: str | None = None,
    child_ts: str = "created_at",
    parent_ts: str = "created_at",
) -> DataFrame:
    """Child rows stamped before their parent, with ``parent_created_at`` added.

    The parent side is unique on its key; a parent with very many children is
    split by the adaptive skew join.
    """
    up = parent.select(
        F.col(parent_key or key).alias("_parent"), F.col(parent_ts).alias("parent_created_at")
    )
    return (
        child.join(up, F.col(key) == F.col("_parent"))
        .where(F.col(child_ts) < F.col("parent_created_at"))
        .drop("_parent")
    )
