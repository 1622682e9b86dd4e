"""Text cleaning rules shared by all analyses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tag(name: str | Column) -> Column:
    """Source, campaign or device: case and outer blanks do not count."""
    return F.lower(F.trim(F.col(name) if isinstance(name, str) else name))


def url(name: str | Column = "pageview_url") -> Column:
    """Page path: case does not count, blanks do."""
    return F.lower(F.col(name) if isinstance(name, str) else name)


def referer(name: str | Column = "http_referer") -> Column:
    """NULL, empty and blank referers are one value, the empty string."""
    return F.coalesce(F.trim(F.col(name) if isinstance(name, str) else name), F.lit(""))


def untrimmed(*names: str) -> Column:
    """True where any of the columns has outer blanks; NULLs never qualify."""
    found = F.lit(False)
    for name in names:
        found = found | (F.col(name) != F.trim(F.col(name)))
    return found
