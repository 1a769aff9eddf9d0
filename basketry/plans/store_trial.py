"""Second analysis: choose control stores and assess the trial stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.dates import month_start, yearmonth
from basketry.functions.values import smallest_first
from basketry.operators import control, stores, table_functions, uplift
from basketry.plans import fixture as fx
from basketry.plans.rounding import fixed
from basketry.session import stage
from basketry.sources import tpch

DESIGN = fx.DESIGN
_COLUMNS = ("DATE", "STORE_NBR", "LYLTY_CARD_NBR", "TXN_ID", "PROD_QTY", "TOT_SALES")


def _measures(spark: SparkSession, root: str) -> DataFrame:
    return stores.store_month_measures(tpch.transactions(spark, root, _COLUMNS))


def _staged_measures(spark: SparkSession, root: str) -> DataFrame:
    """Measures the trial steps need, written once: several branches read them."""
    txns = tpch.transactions(spark, root, ("DATE", "STORE_NBR", "LYLTY_CARD_NBR", "TOT_SALES"))
    monthly = stores.with_observed_months(stores.sales_and_customers(stores.by_customer(txns)), DESIGN)
    return stage(monthly)


def _pre(observed: DataFrame) -> DataFrame:
    return stores.pre_trial_measures(observed, DESIGN)


def _chosen(measures: DataFrame, mixed_magnitude=()) -> DataFrame:
    scores = control.control_scores(_pre(measures), DESIGN, mixed_magnitude)
    return uplift.assignments(control.control_store(scores))


def _assessed(
    spark, root, mixed_magnitude=(), compare_with=None, sd_over_all_months=(), band_on="raw"
):
    measures = _staged_measures(spark, root)
    series = uplift.paired_series(
        measures,
        _chosen(measures, mixed_magnitude),
        compare_with=compare_with,
    )
    return uplift.assess(series, DESIGN, sd_over_all_months, band_on)


# --- months and measures ----------------------------------------------------------------


def yearmonth_of_dates(spark, root):
    dates = tpch.transactions(spark, root, ("DATE",)).distinct()
    return dates.withColumn("YEARMONTH", yearmonth(F.col("DATE")))


def transaction_month(spark, root):
    months = tpch.transactions(spark, root, ("DATE",)).select(
        yearmonth(F.col("DATE")).alias("YEARMONTH")
    )
    return months.distinct().withColumn("TransactionMonth", month_start(F.col("YEARMONTH")))


def store_month_measures(spark, root):
    return fixed(_measures(spark, root), totSales=2).orderBy(*smallest_first("STORE_NBR", "YEARMONTH"))


def stores_full_obs(spark, root):
    months = stores.store_months(tpch.transactions(spark, root, ("DATE", "STORE_NBR")))
    return stores.full_observation_stores(months, DESIGN)


def pre_trial_measures(spark, root):
    observed = stores.with_observed_months(_measures(spark, root), DESIGN)
    return fixed(_pre(observed), totSales=2)


# --- control stores ---------------------------------------------------------------------


def store_pairs(spark, root):
    pre = _pre(_staged_measures(spark, root))
    return fixed(control.store_pairs(pre, DESIGN.trials), v1=2, v2=2, distance=2)


def store_correlation(spark, root):
    return fixed(control.store_correlation(_pre(_staged_measures(spark, root)), DESIGN.trials))


def store_magnitude(spark, root):
    return fixed(control.store_magnitude(_pre(_staged_measures(spark, root)), DESIGN.trials))


def _scores(spark, root, mixed_magnitude=()):
    pre = _pre(_staged_measures(spark, root))
    return control.control_scores(pre, DESIGN, mixed_magnitude)


def control_scores(spark, root):
    return fixed(_scores(spark, root))


def control_store(spark, root):
    return fixed(control.control_store(_scores(spark, root)))


def control_store_mixed_magnitude(spark, root):
    return fixed(control.control_store(_scores(spark, root, [fx.SECOND_TRIAL])))


def _asked(spark, root, call: str) -> DataFrame:
    """A table function in SQL, called for every trial store and metric."""
    table_functions.register(_pre(_staged_measures(spark, root)), view="pre_trial")
    calls = [
        f"SELECT *, '{m}' AS metric FROM {call}('{m}', {t})" for t in DESIGN.trials for m in stores.METRICS
    ]
    return spark.sql(" UNION ALL ".join(calls))


def store_correlation_function(spark, root):
    return fixed(_asked(spark, root, table_functions.CORRELATION))


def store_magnitude_function(spark, root):
    return fixed(_asked(spark, root, table_functions.MAGNITUDE))


def control_store_function(spark, root):
    """The control stores by one SQL statement over the functions."""
    table_functions.register(_pre(_staged_measures(spark, root)), view="pre_trial")
    weight = DESIGN.corr_weight
    calls = [f"SELECT * FROM {table_functions.SCORES}({t}, {weight}D)" for t in DESIGN.trials]
    ranked = f"""SELECT *, row_number() OVER (
  PARTITION BY Store1 ORDER BY finalControlScore DESC NULLS LAST, Store2) AS place
FROM ({" UNION ALL ".join(calls)}) WHERE Store1 <> Store2"""
    return fixed(spark.sql(f"SELECT Store1, Store2, finalControlScore FROM ({ranked}) WHERE place = 1"))


# --- trends and assessment --------------------------------------------------------------


def store_type_labels(spark, root):
    measures = _staged_measures(spark, root)
    labelled = uplift.store_type_labels(measures, _chosen(measures))
    return labelled.select("trial", "STORE_NBR", "YEARMONTH", "Store_type")


def store_type_trend(spark, root):
    measures = _staged_measures(spark, root)
    trend = uplift.store_type_trend(measures, _chosen(measures), DESIGN)
    return fixed(trend, totSales=2)


def scaling_factors(spark, root):
    return fixed(uplift.scaling_factors(_assessed(spark, root)))


def scaled_control(spark, root):
    return fixed(uplift.scaled_control(_assessed(spark, root)), raw=2, scaled=4)


def trial_vs_control_pct_diff(spark, root):
    return fixed(uplift.percentage_differences(_assessed(spark, root)), trial_value=2, scaled=4)


def pct_diff_sd_all_months(spark, root):
    assessed = _assessed(spark, root, sd_over_all_months=[(fx.SECOND_TRIAL, "totSales")])
    return fixed(uplift.percentage_differences(assessed), trial_value=2, scaled=4)


def pct_diff_other_store(spark, root):
    assessed = _assessed(
        spark, root, compare_with={(fx.SECOND_TRIAL, "nCustomers"): fx.FIRST_TRIAL}
    )
    return fixed(uplift.percentage_differences(assessed), trial_value=2, scaled=4)


def trial_t_values(spark, root):
    return fixed(uplift.trial_t_values(_assessed(spark, root), DESIGN))


def trial_bands(spark, root):
    return fixed(uplift.trial_bands(_assessed(spark, root)), digits=4)


def trial_bands_scaled(spark, root):
    return fixed(uplift.trial_bands(_assessed(spark, root, band_on="scaled")), digits=4)


def trial_window_bounds(spark, root):
    return uplift.trial_window_bounds(_assessed(spark, root), DESIGN)


def trial_verdict(spark, root):
    return uplift.trial_verdict(_assessed(spark, root), DESIGN)


def trial_verdict_as_written(spark, root):
    """The verdict with all three deviations of the original run for its second trial store."""
    second, first = fx.SECOND_TRIAL, fx.FIRST_TRIAL
    assessed = _assessed(
        spark,
        root,
        mixed_magnitude=[second],
        compare_with={(second, "nCustomers"): first},
        sd_over_all_months=[(second, "totSales")],
    )
    return uplift.trial_verdict(assessed, DESIGN)


QUERIES = {
    "yearmonth": yearmonth_of_dates,
    **{
        query.__name__: query
        for query in (
            transaction_month,
            store_month_measures,
            stores_full_obs,
            pre_trial_measures,
            store_pairs,
            store_correlation,
            store_magnitude,
            control_scores,
            control_store,
            control_store_mixed_magnitude,
            store_correlation_function,
            store_magnitude_function,
            control_store_function,
            store_type_labels,
            store_type_trend,
            scaling_factors,
            scaled_control,
            trial_vs_control_pct_diff,
            pct_diff_sd_all_months,
            pct_diff_other_store,
            trial_t_values,
            trial_bands,
            trial_bands_scaled,
            trial_window_bounds,
            trial_verdict,
            trial_verdict_as_written,
        )
    },
}
