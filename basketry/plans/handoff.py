"""The hand-off between the analyses: bucketed, kept by month with mergeable state, checked as it is written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.dates import yearmonth
from basketry.operators import cleaning, members, segments, stores
from basketry.plans import fixture as fx
from basketry.plans.rounding import fixed
from basketry.session import stage, staging_path
from basketry.sources import handoff, tpch

_COLUMNS = ("DATE", "STORE_NBR", "LYLTY_CARD_NBR", "TXN_ID", "PROD_QTY", "TOT_SALES")


def _quarter(month):
    return (F.floor(month / 100) * 10 + F.floor((month % 100 + 2) / 3)).cast("int").alias("QUARTER")


def _kept_months(spark: SparkSession, root: str) -> handoff.MonthlyHandoff:
    kept = handoff.MonthlyHandoff(spark, staging_path(spark))
    kept.update(tpch.transactions(spark, root, _COLUMNS))
    return kept


def store_measures_bucketed(spark: SparkSession, root: str) -> DataFrame:
    """The monthly measures from a hand-off bucketed by store and month."""
    table = f"handoff_{uuid.uuid4().hex}"
    buckets = handoff.buckets_for(tpch.table(spark, root, "lineitem").count(), 16)  # a count of the file footers
    handoff.write_bucketed(tpch.transactions(spark, root, _COLUMNS), table, buckets)
    return fixed(stores.store_month_measures(spark.table(table), co_located=True), totSales=2)


def store_measures_from_state(spark: SparkSession, root: str) -> DataFrame:
    """The monthly measures from the kept sums and distinct-count state, after a month was restated."""
    txns = tpch.transactions(spark, root, _COLUMNS)
    kept = _kept_months(spark, root)
    in_month = yearmonth(F.col("DATE")) == fx.RESTATED_MONTH
    kept.update(txns.filter(in_month & (F.col("PROD_QTY") >= fx.RESTATED_QTY)))
    return fixed(kept.measures(), totSales=2)


def store_customers_quarter(spark: SparkSession, root: str) -> DataFrame:
    """Distinct customers per store and quarter, merged from the monthly state."""
    cards = _kept_months(spark, root).members("cards").withColumn("QUARTER", _quarter(F.col("YEARMONTH")))
    return members.distinct_over(cards, ["STORE_NBR", "QUARTER"], "nCustomers")


def segment_customers_quarter(spark: SparkSession, root: str) -> DataFrame:
    """Distinct customers per segment and quarter, merged from a staged state per segment and month."""
    cards = tpch.transactions(spark, root, ("DATE", "LYLTY_CARD_NBR")).select(
        yearmonth(F.col("DATE")).alias("YEARMONTH"), "LYLTY_CARD_NBR"
    )
    named = segments.enrich(cards.distinct(), tpch.customers(spark, root))
    state = stage(members.member_state(named, [*segments.SEGMENT, "YEARMONTH"], "LYLTY_CARD_NBR"))
    quarters = state.withColumn("QUARTER", _quarter(F.col("YEARMONTH")))
    return members.distinct_over(quarters, [*segments.SEGMENT, "QUARTER"], "CUSTOMERS")


def handoff_checks(spark: SparkSession, root: str) -> DataFrame:
    """All checks of the enriched table, observed while it is written."""
    txns = tpch.transactions(spark, root, tpch.ALL_COLUMNS, fx.GAPS)
    kept = cleaning.exclude_products(txns, fx.EXCLUDED)
    enriched = segments.enrich(cleaning.product_features(kept, fx.BRAND_ALIASES), tpch.customers(spark, root))
    found = handoff.write_checked(enriched, staging_path(spark), fx.EXCLUDED)
    return spark.createDataFrame(
        [(name, str(value)) for name, value in found.items()], "check string, value string"
    )


QUERIES = {
    query.__name__: query
    for query in (
        store_measures_bucketed,
        store_measures_from_state,
        store_customers_quarter,
        segment_customers_quarter,
        handoff_checks,
    )
}
