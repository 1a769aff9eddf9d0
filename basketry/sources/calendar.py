"""Inclusive daily calendars."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def calendar_between(spark: SparkSession, first: dt.date, last: dt.date) -> DataFrame:
    """One row per day from ``first`` to ``last``."""
    n_days = (last - first).days + 1
    return spark.range(n_days).select(
        F.date_add(F.lit(first), F.col("id").cast("int")).alias("DATE")
    )


def calendar_of(df: DataFrame, column: str = "DATE") -> DataFrame:
    """One row per day between the first and last date found in ``df``."""
    bounds = df.agg(F.min(column).alias("first"), F.max(column).alias("last"))
    return bounds.filter(F.col("first").isNotNull()).select(
        F.explode(F.sequence("first", "last")).alias("DATE")
    )
