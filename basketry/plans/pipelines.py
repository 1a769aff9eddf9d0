"""Both analyses over a user's own tables: transactions, customers and the enriched hand-off.

Every function returns lazy DataFrames by name; nothing runs before an action, except that
``prepare`` writes the hand-off table, ``trial`` writes the monthly measures once, and ``summaries``
writes the numeric columns and passes over them. The
defaults are the original run's fixed values.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.values import largest_first, smallest_first
from basketry.operators import cleaning, control, distribution, inference, profiling, quantiles
from basketry.operators import affinity as aff
from basketry.operators import segments, stores, uplift
from basketry.session import stage
from basketry.sources.calendar import calendar_between
from basketry.sources.tables import read_enriched, write_enriched

CARD = segments.CARD

# The observed year, the outlying quantity and the examined pack size.
FIRST_DAY = dt.date(2018, 7, 1)
LAST_DAY = dt.date(2019, 6, 30)
OUTLIER_QTY = 200
PACK_SIZE = 270
COUPLES = ("YOUNG SINGLES/COUPLES", "MIDAGE SINGLES/COUPLES")
MAINSTREAM = "Mainstream"

_NUMERIC = ("DATE", "STORE_NBR", CARD, "TXN_ID", "PROD_QTY", "TOT_SALES")


def profile(
    txns: DataFrame,
    customers: DataFrame,
    excluded: str = cleaning.EXCLUDED_PRODUCT,
    cards: Iterable[int] = (cleaning.OUTLIER_CARD,),
    first_day: dt.date = FIRST_DAY,
    last_day: dt.date = LAST_DAY,
) -> dict[str, DataFrame]:
    """Looks at the raw, the filtered and the cleaned transactions, in the order of the analysis."""
    cards = list(cards)
    kept = cleaning.exclude_products(txns, excluded)
    clean = cleaning.exclude_customers(kept, cards)
    calendar = calendar_between(txns.sparkSession, first_day, last_day)
    by_day = profiling.on_calendar(profiling.daily_counts(clean), calendar)
    return {
        "transaction_schema": profiling.schema_profile(txns),
        "product_counts": profiling.counts(txns, "PROD_NAME"),
        "product_words": profiling.word_counts(txns),
        "excluded_products_left": cleaning.only_products(kept, excluded),
        "cards": kept.select(CARD).distinct(),
        "repeat_customers": profiling.repeats(kept, CARD, top=50),
        "repeat_transactions": profiling.repeats(kept, "TXN_ID", top=10),
        "repeat_card_transactions": profiling.repeats(kept, CARD, "TXN_ID"),
        "quantity_outliers": kept.filter(F.col("PROD_QTY") == OUTLIER_QTY),
        "outlier_customer_rows": kept.filter(F.col(CARD).isin(cards)),
        "null_counts": profiling.null_counts(kept),
        "daily_counts": profiling.daily_counts(clean).orderBy(*smallest_first("DATE")),
        "days": by_day.orderBy(*smallest_first("DATE")),
        "december": by_day.filter(F.month("DATE") == 12).orderBy(*smallest_first("DATE")),
        "missing_days": profiling.missing_days(clean, calendar),
        "date_coverage": profiling.date_coverage(clean),
        "customer_schema": profiling.schema_profile(customers),
        "customers_by_lifestage": profiling.counts(customers, "LIFESTAGE"),
        "customers_by_premium": profiling.counts(customers, "PREMIUM_CUSTOMER"),
        "join_quality": profiling.join_quality(clean, customers),
    }


def summaries(
    txns: DataFrame,
    customers: DataFrame,
    excluded: str = cleaning.EXCLUDED_PRODUCT,
    cards: Iterable[int] = (cleaning.OUTLIER_CARD,),
) -> dict[str, DataFrame]:
    """Numeric and text summaries before and after dropping the outlier, and of the customers."""
    kept = cleaning.exclude_products(txns, excluded)
    clean = cleaning.exclude_customers(kept, cards)
    return {
        "before": quantiles.numeric_summary(kept, _NUMERIC),
        "after": quantiles.numeric_summary(clean, _NUMERIC),
        "customers": quantiles.numeric_summary(customers, [CARD]),
        "transaction_text": profiling.text_summary(txns),
        "customer_text": profiling.text_summary(customers),
    }


def prepare(
    txns: DataFrame,
    customers: DataFrame,
    path: str,
    excluded: str = cleaning.EXCLUDED_PRODUCT,
    cards: Iterable[int] = (cleaning.OUTLIER_CARD,),
    aliases: Mapping[str, str] = cleaning.BRAND_ALIASES,
) -> DataFrame:
    """Clean, derive product features, join customers, write by month, and read back."""
    clean = cleaning.clean_transactions(txns, excluded, cards)
    featured = cleaning.product_features(clean, aliases)
    write_enriched(segments.enrich(featured, customers), path)
    return read_enriched(txns.sparkSession, path)


def review(
    enriched: DataFrame,
    lifestage: str = aff.TARGET_LIFESTAGE,
    premium: str = MAINSTREAM,
    test_lifestages: Sequence[str] = COUPLES,
    pack_size: float = PACK_SIZE,
) -> dict[str, DataFrame]:
    """Products, segments, the price test and the affinities of the target segment."""
    per_segment = segments.segment_metrics(enriched)
    priced = cleaning.with_price(enriched)
    tested = priced.filter(F.col("LIFESTAGE").isin(list(test_lifestages)))
    in_group = F.col("PREMIUM_CUSTOMER") == premium
    target = aff.in_target(lifestage, premium)
    other = aff.in_comparison(lifestage, premium)

    def ranked(column: str) -> DataFrame:
        return per_segment.select(*segments.SEGMENT, column).orderBy(largest_first(column))

    return {
        "pack_sizes": enriched.groupBy("PACK_SIZE")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(largest_first("PACK_SIZE")),
        "pack_size_histogram": distribution.histogram(enriched, "PACK_SIZE", 30),
        "brands": profiling.counts(enriched, "BRAND"),
        "null_counts": profiling.null_counts(enriched),
        "sales": ranked("SALES"),
        "sales_shares": segments.segment_shares(per_segment, "SALES"),
        "customers": ranked("CUSTOMERS"),
        "customer_shares": segments.segment_shares(per_segment, "CUSTOMERS"),
        "units_per_customer": ranked("UNITS_PER_CUSTOMER"),
        "price_per_unit": ranked("PRICE_PER_UNIT"),
        "price_test": inference.welch_greater(tested, "price", in_group, ~in_group),
        "price_histogram": distribution.histogram(
            segments.with_price_group(priced, premium), "price", 9, by="GROUP"
        ),
        "brand_affinity": aff.affinity(enriched, "BRAND", target, other),
        "pack_affinity": aff.affinity(enriched, "PACK_SIZE", target, other),
        "pack_size_products": aff.products_of_pack_size(enriched, pack_size),
    }


def brand_ranking(enriched: DataFrame) -> DataFrame:
    """Units per brand with their rank; writes the brand sums once when called."""
    return profiling.units_by(enriched, "BRAND")


def trial(
    enriched: DataFrame,
    design: stores.TrialDesign = stores.TrialDesign(),
    band_on: str = "raw",
    as_written: bool = False,
    folder: str | None = None,
) -> dict[str, DataFrame]:
    """Control stores and the assessment of every trial store, for sales and customers.

    ``folder``, shared by all machines, takes the monthly measures; by default it is the one that
    ``spark.checkpoint.dir`` names.

    ``as_written`` keeps three deviations of the original run for its second trial store:
    its sales score takes the customers' closeness, its sales deviation runs over all
    months, and its customers are those of the first trial store.
    """
    first, second = (list(design.trials) + [None, None])[:2]
    odd = as_written and second is not None
    monthly = stage(
        stores.with_observed_months(stores.sales_and_customers(stores.by_customer(enriched)), design), folder
    )
    pre = stores.pre_trial_measures(monthly, design)
    scores = control.control_scores(pre, design, [second] if odd else ())
    controls = control.control_store(scores)
    chosen = uplift.assignments(controls)
    series = uplift.paired_series(
        monthly,
        chosen,
        compare_with={(second, "nCustomers"): first} if odd else None,
    )
    assessed = uplift.assess(series, design, [(second, "totSales")] if odd else (), band_on)
    return {
        "measures": stores.store_month_measures(enriched).orderBy(*smallest_first("STORE_NBR", "YEARMONTH")),
        "full_observation_stores": stores.full_observation_stores(monthly, design),
        "correlation": control.store_correlation(pre, design.trials),
        "magnitude": control.store_magnitude(pre, design.trials),
        "scores": scores,
        "controls": controls,
        "trend": uplift.store_type_trend(monthly, chosen, design),
        "factors": uplift.scaling_factors(assessed),
        "scaled_control": uplift.scaled_control(assessed),
        "differences": uplift.percentage_differences(assessed),
        "t_values": uplift.trial_t_values(assessed, design),
        "bands": uplift.trial_bands(assessed),
        "window": uplift.trial_window_bounds(assessed, design),
        "verdict": uplift.trial_verdict(assessed, design),
    }
