"""Fixed precision for results that are compared across engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def steady_round(value: Column, digits: int) -> Column:
    """Round, with exact halves moved up by a thousandth of a step.

    The last bit of a sum depends on the order of its terms; without the shift it would
    decide how an exact half is rounded. Adding 0.0 turns a negative zero into zero.
    """
    return F.round(value + F.lit(10.0 ** -(digits + 3)), digits) + F.lit(0.0)


def fixed(df: DataFrame, /, digits: int = 6, **per_column: int) -> DataFrame:
    """Round the double columns, to 6 digits unless stated."""
    return df.select(
        [
            steady_round(F.col(name), per_column.get(name, digits)).alias(name)
            if kind == "double"
            else F.col(name)
            for name, kind in df.dtypes
        ]
    )
