"""Assessment of a trial against its scaled control store."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.dates import month_start
from basketry.functions.stats import t_quantile
from basketry.operators.stores import METRICS, TrialDesign

# Labels of the store types and of the plotted series.
TRIAL = "Trial"
CONTROL = "Control"
OTHER = "Other stores"
UPPER = "Control upper"
LOWER = "Control lower"

_SERIES = ("trial", "metric")


def assignments(controls: DataFrame) -> DataFrame:
    """(trial, control) rows from the chosen control stores."""
    return controls.select(
        F.col("Store1").alias("trial"), F.col("Store2").alias("control")
    )


def store_type(store: Column, trial: Column, control: Column) -> Column:
    return (
        F.when(store.isNull() | trial.isNull(), None)
        .when(store == trial, TRIAL)
        .when(store == control, CONTROL)
        .otherwise(OTHER)
    )


def store_type_labels(measures: DataFrame, chosen: DataFrame) -> DataFrame:
    """Every store month labelled once per trial as Trial, Control or Other stores.

    The result is by its nature rows x trials. The chosen pairs, one per listed trial, travel
    as one array value.
    """
    pairs = chosen.agg(F.collect_list(F.struct("trial", "control"))).scalar()
    return (
        measures.withColumn("_pairs", pairs)
        .withColumn("_pair", F.explode("_pairs"))
        .withColumn("trial", F.col("_pair.trial"))
        .withColumn(
            "Store_type",
            store_type(F.col("STORE_NBR"), F.col("_pair.trial"), F.col("_pair.control")),
        )
        .drop("_pairs", "_pair")
    )


def store_type_trend(
    measures: DataFrame, chosen: DataFrame, design: TrialDesign, metrics: Sequence[str] = METRICS
) -> DataFrame:
    """Mean measures per trial, month and store type before the trend's end.

    One row per group instead of the mean repeated on every row. The sums and counts of a month
    are taken once over all stores; the other stores of a trial are those less its own and its
    control's row, so nothing is multiplied by the number of trials but the months. Rows without a store are of no type.
    """
    months = measures.filter(F.col("STORE_NBR").isNotNull() & (F.col("YEARMONTH") < design.trend_end))
    totals = months.groupBy("YEARMONTH").agg(
        F.count(F.lit(1)).alias("_stores"),
        *[F.sum(m).cast("double").alias(f"_sum_{m}") for m in metrics],
        *[F.count(m).alias(f"_n_{m}") for m in metrics],
    )
    roles = F.array(
        F.struct(F.lit(TRIAL).alias("Store_type"), F.col("trial").alias("STORE_NBR")),
        F.struct(F.lit(CONTROL).alias("Store_type"), F.col("control").alias("STORE_NBR")),
    )
    stores = chosen.select("trial", F.explode(roles).alias("r")).select("trial", "r.*")
    known = months.join(stores, "STORE_NBR").select(
        "trial", "YEARMONTH", "Store_type", *[F.col(m).cast("double").alias(m) for m in metrics]
    )
    picked = known.groupBy("trial", "YEARMONTH").agg(
        F.count(F.lit(1)).alias("_own"),
        *[F.sum(m).alias(f"_own_{m}") for m in metrics],
        *[F.count(m).alias(f"_has_{m}") for m in metrics],
    )
    trials = chosen.agg(F.collect_list("trial")).scalar()
    listed = totals.withColumn("trial", F.explode(trials))
    rest = listed.join(picked, ["trial", "YEARMONTH"], "left").filter(
        F.col("_stores") > F.coalesce("_own", F.lit(0))
    )

    def of_rest(metric: str) -> Column:
        left = F.col(f"_sum_{metric}") - F.coalesce(f"_own_{metric}", F.lit(0.0))
        return F.try_divide(left, F.col(f"_n_{metric}") - F.coalesce(f"_has_{metric}", F.lit(0)))

    others = rest.select(
        "trial", "YEARMONTH", F.lit(OTHER).alias("Store_type"), *[of_rest(m).alias(m) for m in metrics]
    )
    return known.union(others).withColumn("TransactionMonth", month_start(F.col("YEARMONTH")))


def paired_series(
    measures: DataFrame,
    chosen: DataFrame,
    metrics: Sequence[str] = METRICS,
    compare_with: Mapping[tuple[int, str], int] | None = None,
) -> DataFrame:
    """Trial and control values per (trial, control, metric, month).

    ``compare_with`` maps (trial, metric) to another store whose values are observed in place
    of the trial's own, as the original run does for the customers of its second store.
    """
    compare_with = dict(compare_with or {})
    wanted = [
        F.struct(F.lit("trial").alias("role"), F.col("trial").alias("STORE_NBR")),
        F.struct(F.lit("control").alias("role"), F.col("control").alias("STORE_NBR")),
    ]
    for (trial, metric), store in compare_with.items():
        instead = F.when(F.col("trial") == trial, F.lit(store).cast("bigint"))
        wanted.append(F.struct(F.lit(f"observed {metric}").alias("role"), instead.alias("STORE_NBR")))
    roles = chosen.select("trial", "control", F.explode(F.array(*wanted)).alias("r")).select(
        "trial", "control", "r.*"
    )

    def value(metric: str, role: str) -> Column:
        return F.max(F.when(F.col("role") == role, F.col(metric)))

    replaced = {metric for _, metric in compare_with}
    months = (
        measures.join(roles, "STORE_NBR")
        .groupBy("trial", "control", "YEARMONTH")
        .agg(
            *[value(m, "trial").alias(f"{m}_trial") for m in metrics],
            *[value(m, "control").alias(f"{m}_control") for m in metrics],
            *[value(m, f"observed {m}").alias(f"{m}_other") for m in sorted(replaced)],
        )
    )

    def observed(metric: str) -> Column:
        own = F.col(f"{metric}_trial")
        trials = [t for t, m in compare_with if m == metric]
        if not trials:
            return own
        return F.when(F.col("trial").isin(trials), F.col(f"{metric}_other")).otherwise(own)

    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.col(f"{m}_trial").cast("double").alias("trial_value"),
                F.col(f"{m}_control").cast("double").alias("raw"),
                observed(m).cast("double").alias("observed"),
            )
            for m in metrics
        ]
    )
    return months.select("trial", "control", "YEARMONTH", F.explode(rows).alias("r")).select(
        "trial", "control", "r.metric", "YEARMONTH", "r.trial_value", "r.raw", "r.observed"
    )


def assess(
    series: DataFrame,
    design: TrialDesign,
    sd_over_all_months: Collection[tuple[int, str]] = (),
    band_on: str = "raw",
) -> DataFrame:
    """Scale the control, compare it with the trial and draw the band, all on the same rows.

    factor    lifts the control to the trial's level before the trial
    pct_diff  distance of the observed value to the scaled control, relative to the latter
    sd_pre    its deviation over the pre-trial months, or over all months for the
              (trial, metric) pairs in ``sd_over_all_months``
    upper, lower  ``band_sds`` deviations around the raw or the scaled control

    The windows run over the months of one trial and metric.
    """
    if band_on not in ("raw", "scaled"):
        raise ValueError("band_on is 'raw' or 'scaled'")
    months = Window.partitionBy(*_SERIES)
    before = design.in_pre()
    factor = F.try_divide(
        F.sum(F.when(before, F.col("trial_value"))).over(months),
        F.sum(F.when(before, F.col("raw"))).over(months),
    )
    scaled = series.withColumn("factor", factor).withColumn(
        "scaled", F.col("raw") * F.col("factor")
    )
    compared = scaled.withColumn(
        "pct_diff", F.try_divide(F.abs(F.col("scaled") - F.col("observed")), F.col("scaled"))
    )
    period = before
    for trial, metric in sd_over_all_months:
        period = period | ((F.col("trial") == trial) & (F.col("metric") == metric))
    sd = F.stddev_samp(F.when(period, F.col("pct_diff"))).over(months)
    width = F.col("sd_pre") * design.band_sds
    return compared.withColumn("sd_pre", sd).withColumns(
        {
            "tValue": F.try_divide("pct_diff", "sd_pre"),
            "upper": F.col(band_on) * (1 + width),
            "lower": F.col(band_on) * (1 - width),
        }
    )


def scaling_factors(assessed: DataFrame) -> DataFrame:
    return assessed.select("trial", "control", "metric", "factor").distinct()


def scaled_control(assessed: DataFrame) -> DataFrame:
    rows = assessed.filter(F.col("raw").isNotNull())
    return rows.select("trial", "metric", "YEARMONTH", "raw", "factor", "scaled")


def _both_present() -> Column:
    return F.col("scaled").isNotNull() & F.col("observed").isNotNull()


def percentage_differences(assessed: DataFrame) -> DataFrame:
    """Months in which both stores have a value, with their relative difference."""
    return assessed.filter(_both_present()).select(
        "trial",
        "metric",
        "YEARMONTH",
        "scaled",
        F.col("observed").alias("trial_value"),
        "pct_diff",
        "sd_pre",
    )


def _critical_value(assessed: DataFrame, design: TrialDesign) -> Column:
    """The design's t quantile, computed once per query."""
    one = assessed.sparkSession.range(1)
    return one.select(t_quantile(design.level, F.lit(float(design.df)))).scalar()


def trial_t_values(assessed: DataFrame, design: TrialDesign) -> DataFrame:
    """t-values of the trial months against the critical value."""
    tested = assessed.filter(_both_present() & design.in_trial()).select(
        "trial",
        "metric",
        month_start(F.col("YEARMONTH")).alias("TransactionMonth"),
        "tValue",
        _critical_value(assessed, design).alias("t_crit"),
    )
    return tested.withColumn("significant", F.col("tValue") > F.col("t_crit"))


def trial_bands(assessed: DataFrame) -> DataFrame:
    """Long table of the trial, the control and the band around it, for every month."""

    def line(name: str, value: str, base: str) -> Column:
        return F.struct(
            F.lit(name).alias("series"),
            F.col(value).alias("value"),
            F.col(base).isNotNull().alias("observed"),
        )

    lines = F.array(
        line(TRIAL, "trial_value", "trial_value"),
        line(CONTROL, "raw", "raw"),
        line(UPPER, "upper", "raw"),
        line(LOWER, "lower", "raw"),
    )
    return (
        assessed.select("trial", "metric", "YEARMONTH", F.explode(lines).alias("r"))
        .filter("r.observed")
        .select(
            "trial",
            "metric",
            "YEARMONTH",
            month_start(F.col("YEARMONTH")).alias("TransactionMonth"),
            "r.series",
            "r.value",
        )
    )


def trial_window_bounds(series: DataFrame, design: TrialDesign) -> DataFrame:
    """First and last observed trial month per trial."""
    month = month_start(F.col("YEARMONTH"))
    return (
        series.filter(design.in_trial())
        .groupBy("trial")
        .agg(F.min(month).alias("first_month"), F.max(month).alias("last_month"))
    )


def trial_verdict(assessed: DataFrame, design: TrialDesign) -> DataFrame:
    """Trial months in which the trial left the band, and those with a significant t-value."""
    outside = (F.col("trial_value") > F.col("upper")) | (F.col("trial_value") < F.col("lower"))
    return (
        assessed.withColumn("t_crit", _critical_value(assessed, design))
        .filter(_both_present() & design.in_trial())
        .groupBy("trial", "metric")
        .agg(
            F.count_if(outside).alias("months_outside"),
            F.count(F.lit(1)).alias("months_total"),
            F.count_if(F.col("tValue") > F.col("t_crit")).alias("significant_months"),
        )
    )
