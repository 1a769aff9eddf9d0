"""Missing values, distinct counts and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, and for floating point also NaN."""
    c = F.col(name)
    if dict(df.dtypes)[name] in ("double", "float"):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def n_unique(name: str) -> Column:
    """Exact distinct count in which all missing values count as one value."""
    c = F.col(name)
    return F.count_distinct(c) + F.max(F.when(c.isNull(), 1).otherwise(0))


def two_way(column: Column, value: str, otherwise: str) -> Column:
    """``value`` where the column equals it, else ``otherwise``; missing stays missing."""
    return F.when(column.isNull(), None).when(column == value, value).otherwise(otherwise)


def percent_label(share: Column) -> Column:
    """Share as percent text with at most one decimal, such as ``12.3 %`` or ``12 %``."""
    percent = (F.round(share, 3) * 100).cast("decimal(9,1)").cast("string")
    return F.concat(F.regexp_replace(percent, r"\.0$", ""), F.lit(" %"))


def known_number(column: Column | str) -> Column:
    """The column as double with NaN as missing."""
    value = F.col(column) if isinstance(column, str) else column
    return F.nanvl(value.cast("double"), F.lit(None))


def largest_first(name: str) -> Column:
    """Descending order of a numeric column with missing values, NaN among them, last."""
    value = F.col(name)
    return F.when(F.isnan(value.cast("double")), None).otherwise(value).desc_nulls_last()


def smallest_first(*names: str) -> list[Column]:
    """Ascending order with missing values last."""
    return [F.col(name).asc_nulls_last() for name in names]
