"""Monthly measures per store and the stores observed in every month."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.dates import yearmonth
from basketry.functions.values import known_number
from basketry.session import spread

METRICS = ("totSales", "nCustomers")


@dataclass(frozen=True)
class TrialDesign:
    """Run parameters of a store trial. The defaults are the original run's fixed values.

    Months are yyyymm integers; ``pre_end`` and ``trend_end`` are exclusive, the trial months
    inclusive. A store is eligible with rows in ``n_months`` months; ``observed_until``
    (exclusive) leaves a month that is still incomplete out of that count.
    """

    trials: Sequence[int] = (77, 86, 88)
    pre_end: int = 201902
    trial_start: int = 201902
    trial_end: int = 201904
    trend_end: int = 201903
    n_months: int = 12
    observed_until: int | None = None
    corr_weight: float = 0.5
    df: float = 7
    band_sds: float = 2
    level: float = 0.95

    def in_pre(self) -> Column:
        return F.col("YEARMONTH") < self.pre_end

    def in_trial(self) -> Column:
        return F.col("YEARMONTH").between(self.trial_start, self.trial_end)


def _dated(txns: DataFrame) -> DataFrame:
    return txns if "YEARMONTH" in txns.columns else txns.withColumn("YEARMONTH", yearmonth(F.col("DATE")))


def by_customer(txns: DataFrame) -> DataFrame:
    """The lines with their month, dealt out by (store, month, customer) for sums per customer.

    Customers of a store and month are nearly as many as its lines, so the task that reads the lines would
    hold almost all of them in a hash table without making them fewer.
    """
    return spread(_dated(txns), "STORE_NBR", "YEARMONTH", "LYLTY_CARD_NBR")


def store_month_measures(txns: DataFrame, co_located: bool = False) -> DataFrame:
    """Sales, customers, transactions per customer, units per transaction and unit price.

    The lines are added up per (store, month, customer), and told apart per (store, month, transaction);
    both then count by store and month. So no line is copied for the two distinct counts, and a store with
    very many rows is spread over all tasks; a task holds the customers of its share of the
    partitions that the session names, however few cores there are. NaN is a missing number, as NULL is;
    missing ids count as one.

    ``co_located`` is for tables bucketed by store and month, in which both are known: nothing is moved then.
    """
    key = ["STORE_NBR", "YEARMONTH"]
    months = _dated(txns) if co_located else by_customer(txns)
    baskets = _dated(txns).select(*key, "TXN_ID")
    per_customer = months.groupBy(*key, "LYLTY_CARD_NBR").agg(
        F.sum(known_number("TOT_SALES")).alias("sales"), F.sum(known_number("PROD_QTY")).alias("units")
    )
    sums = per_customer.groupBy(*key).agg(
        F.sum("sales").alias("totSales"), F.sum("units").alias("units"), F.count(F.lit(1)).alias("nCustomers")
    )
    baskets = baskets if co_located else spread(baskets, *key, "TXN_ID")
    txns_of = baskets.distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("txns"))
    if co_located:
        met = sums.join(txns_of.hint("merge"), key)
    else:
        other = txns_of.withColumnsRenamed({k: f"_{k}" for k in key})
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
        met = sums.join(other, same[0] & same[1])
    return measures_of_sums(met)


def measures_of_sums(sums: DataFrame) -> DataFrame:
    """The measures from totSales, units, nCustomers and txns per store and month."""
    return sums.select(
        "STORE_NBR",
        "YEARMONTH",
        "totSales",
        "nCustomers",
        F.try_divide("txns", "nCustomers").alias("nTxnPerCust"),
        F.try_divide("units", "txns").alias("nChipsPerTxn"),
        F.try_divide("totSales", "units").alias("avgPricePerUnit"),
    )


def sales_and_customers(txns: DataFrame) -> DataFrame:
    """The two measures that the trial steps use, summed per customer before they are counted.

    Lines that are not bucketed by store and month come through ``by_customer``.
    """
    per_customer = (
        _dated(txns).groupBy("STORE_NBR", "YEARMONTH", "LYLTY_CARD_NBR")
        .agg(F.sum(known_number("TOT_SALES")).alias("sales"))
    )
    return per_customer.groupBy("STORE_NBR", "YEARMONTH").agg(
        F.sum("sales").alias("totSales"), F.count(F.lit(1)).alias("nCustomers")
    )


def store_months(txns: DataFrame) -> DataFrame:
    """The months in which each store has rows."""
    return txns.select("STORE_NBR", yearmonth(F.col("DATE")).alias("YEARMONTH")).distinct()


def _counted_month(design: TrialDesign) -> Column:
    if design.observed_until is None:
        return F.lit(1)
    return F.when(F.col("YEARMONTH") < design.observed_until, 1).otherwise(0)


def full_observation_stores(measures: DataFrame, design: TrialDesign) -> DataFrame:
    """Stores with a row in each of the design's months."""
    per_store = measures.groupBy("STORE_NBR").agg(F.sum(_counted_month(design)).alias("n"))
    return per_store.filter(F.col("n") == design.n_months).select("STORE_NBR")


def with_observed_months(measures: DataFrame, design: TrialDesign) -> DataFrame:
    """Add the number of observed months of the row's store.

    The window per store holds one row per month. It leaves the rows sorted by store, so a
    table written from it has the months of a store side by side.
    """
    months = F.sum(_counted_month(design)).over(Window.partitionBy("STORE_NBR"))
    return measures.withColumn("observed_months", months)


def pre_trial_measures(observed: DataFrame, design: TrialDesign) -> DataFrame:
    """Pre-trial months of the fully observed stores; a plain filter on the counted months."""
    full = F.col("observed_months") == design.n_months
    return observed.filter(full & design.in_pre()).drop("observed_months")
