"""How much more a target segment buys a brand or pack size than a comparison segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.values import largest_first

# The segment that is looked at.
TARGET_LIFESTAGE = "YOUNG SINGLES/COUPLES"
TARGET_PREMIUM = "Mainstream"


def in_target(lifestage: str = TARGET_LIFESTAGE, premium: str = TARGET_PREMIUM) -> Column:
    return (F.col("LIFESTAGE") == lifestage) & (F.col("PREMIUM_CUSTOMER") == premium)


def in_comparison(lifestage: str = TARGET_LIFESTAGE, premium: str = TARGET_PREMIUM) -> Column:
    """Same premium type, any other lifestage."""
    return (F.col("LIFESTAGE") != lifestage) & (F.col("PREMIUM_CUSTOMER") == premium)


def segment_units(
    enriched: DataFrame, key: str, target: Column | None = None, other: Column | None = None
) -> DataFrame:
    """Units per ``key`` bought by the target and by the comparison, side by side in one pass."""
    target = in_target() if target is None else target
    other = in_comparison() if other is None else other
    return (
        enriched.filter(target | other)
        .groupBy(key)
        .agg(
            F.sum(F.when(target, F.col("PROD_QTY"))).alias("target_units"),
            F.sum(F.when(other, F.col("PROD_QTY"))).alias("other_units"),
        )
    )


def affinity_of_units(units: DataFrame, by: str) -> DataFrame:
    """Unit shares of ``by`` in both segments and their ratio, largest first.

    Values bought by one segment only are left out, as an inner join of two separate tables
    would do.
    """
    sums = units.groupBy(by).agg(
        F.sum("target_units").alias("target_units"), F.sum("other_units").alias("other_units")
    )
    totals = sums.agg(
        F.struct(
            F.sum("target_units").alias("target"), F.sum("other_units").alias("other")
        ).alias("total")
    )
    return (
        sums.filter(F.col("target_units").isNotNull() & F.col("other_units").isNotNull())
        .withColumn("total", totals.scalar())
        .select(
            by,
            F.try_divide("target_units", "total.target").alias("targetSegment"),
            F.try_divide("other_units", "total.other").alias("other"),
        )
        .withColumn("affinity", F.try_divide("targetSegment", "other"))
        .orderBy(largest_first("affinity"), by)
    )


def affinity(
    enriched: DataFrame, by: str, target: Column | None = None, other: Column | None = None
) -> DataFrame:
    return affinity_of_units(segment_units(enriched, by, target, other), by)


def products_of_pack_size(df: DataFrame, size: float) -> DataFrame:
    return df.filter(F.col("PACK_SIZE") == size).select("PROD_NAME").distinct()
