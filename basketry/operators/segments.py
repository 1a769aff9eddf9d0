"""Customer join and metrics per customer segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.values import percent_label, two_way

CARD = "LYLTY_CARD_NBR"
SEGMENT = ("LIFESTAGE", "PREMIUM_CUSTOMER")


def enrich(
    txns: DataFrame, customers: DataFrame, how: str = "left", null_safe: bool = False
) -> DataFrame:
    """Join of transactions to customers by card. The left join neither loses nor hides a row.

    The physical join is left to adaptive execution: it broadcasts the customers when they
    are small at run time and splits the partition of a heavy card otherwise. ``null_safe``
    lets a missing card match a missing card.
    """
    if not null_safe:
        return txns.join(customers, CARD, how)
    right = customers.withColumnRenamed(CARD, "_card")
    return txns.join(right, F.col(CARD).eqNullSafe(F.col("_card")), how).drop("_card")


def card_totals(txns: DataFrame) -> DataFrame:
    """Sales and units per card, under the names of the transaction columns.

    Joined to the customers in place of the single rows, a heavy card is one row, and the
    join reuses the partitioning of these sums.
    """
    return txns.groupBy(CARD).agg(
        F.sum("TOT_SALES").alias("TOT_SALES"), F.sum("PROD_QTY").alias("PROD_QTY")
    )


def segment_metrics(enriched: DataFrame) -> DataFrame:
    """SALES, CUSTOMERS, units per customer and average unit price per segment.

    Takes enriched transactions or enriched card totals. The customers are counted by
    merging each card first; a missing card is one customer.
    """
    per_card = enriched.groupBy(*SEGMENT, CARD).agg(
        F.sum("TOT_SALES").alias("sales"), F.sum("PROD_QTY").alias("units")
    )
    totals = per_card.groupBy(*SEGMENT).agg(
        F.sum("sales").alias("SALES"),
        F.sum("units").alias("UNITS"),
        F.count(F.lit(1)).alias("CUSTOMERS"),
    )
    return totals.select(
        *SEGMENT,
        "SALES",
        "CUSTOMERS",
        F.try_divide("UNITS", "CUSTOMERS").alias("UNITS_PER_CUSTOMER"),
        F.try_divide("SALES", "UNITS").alias("PRICE_PER_UNIT"),
    )


def segment_shares(segments: DataFrame, weight: str) -> DataFrame:
    """Share of the grand total, of the lifestage, and within the lifestage, with a label."""
    chosen = segments.select(*SEGMENT, weight)
    total = chosen.agg(F.sum(weight)).scalar()
    lifestage = F.sum(weight).over(Window.partitionBy("LIFESTAGE"))
    return (
        chosen.withColumn("total", total)
        .withColumn("lifestage_sum", lifestage)
        .select(
            *SEGMENT,
            weight,
            F.try_divide(weight, "total").alias("share_total"),
            F.try_divide("lifestage_sum", "total").alias("lifestage_share"),
            F.try_divide(weight, "lifestage_sum").alias("share_in_lifestage"),
        )
        .withColumn("label", percent_label(F.col("share_total")))
    )


def with_price_group(enriched: DataFrame, value: str = "Mainstream") -> DataFrame:
    """GROUP is the premium type ``value`` or ``Non-<value>``."""
    return enriched.withColumn(
        "GROUP", two_way(F.col("PREMIUM_CUSTOMER"), value, f"Non-{value}")
    )


def first_priced_rows(priced: DataFrame, customers: DataFrame, n: int = 6) -> DataFrame:
    """First ``n`` rows of (GROUP, price) by transaction, product, price and card.

    A left join never drops a row, so the first ``n`` rows after it come from the first ``n``
    rows before it: the rows are picked first and only those are joined.
    """
    order = [F.asc_nulls_last(c) for c in ("TXN_ID", "PROD_NAME", "price", CARD)]
    first = priced.orderBy(*order).limit(n)
    grouped = with_price_group(enrich(first, customers))
    return grouped.orderBy(*order, F.asc_nulls_last("GROUP")).limit(n).select(
        "GROUP", "price", "TXN_ID"
    )
