"""First analysis: profile and clean transactions, join customers, compare segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.dates import date_to_serial, serial_to_date, yearmonth
from basketry.functions.values import largest_first, smallest_first
from basketry.operators import affinity as aff
from basketry.operators import aliases, cleaning, distribution, inference, outliers, profiling, quantiles, segments
from basketry.plans import fixture as fx
from basketry.plans.rounding import fixed
from basketry.session import stage, staging_path
from basketry.sources import tables, tpch
from basketry.sources.calendar import calendar_between, calendar_of

CARD = "LYLTY_CARD_NBR"


def _products_excluded(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """Transactions after the product filter, before the outlier customer is dropped.

    Without the name among the columns, the lines lose the few excluded part keys by an anti join,
    and the names are not read into the plan.
    """
    if "PROD_NAME" not in columns:
        return tpch.transactions(spark, root, columns, without=fx.EXCLUDED)
    return cleaning.exclude_products(tpch.transactions(spark, root, columns), fx.EXCLUDED)


def _clean(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    kept = _products_excluded(spark, root, *dict.fromkeys((*columns, CARD)))
    return cleaning.exclude_customers(kept, [fx.OUTLIER_CARD])


def _featured(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    return cleaning.product_features(_clean(spark, root, *columns), fx.BRAND_ALIASES)


def _enriched(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    return segments.enrich(_featured(spark, root, *columns), tpch.customers(spark, root))


# --- load and look at the raw table -----------------------------------------------------


def load_transactions(spark, root):
    return tpch.transactions(spark, root)


def load_customers(spark, root):
    return tpch.customers(spark, root)


def schema_profile(spark, root):
    return profiling.schema_profile(tpch.transactions(spark, root))


def customer_schema_profile(spark, root):
    return profiling.schema_profile(tpch.customers(spark, root))


def excel_serial_dates(spark, root):
    dates = tpch.transactions(spark, root, ("DATE",)).distinct()
    serials = dates.select(date_to_serial(F.col("DATE")).alias("serial"))
    return serials.select("serial", serial_to_date(F.col("serial")).alias("DATE"))


def product_counts(spark, root):
    return profiling.counts(tpch.product_totals(spark, root), "PROD_NAME", weight="n")


def product_words(spark, root):
    return profiling.word_counts(tpch.product_totals(spark, root))


# --- filters ----------------------------------------------------------------------------


def exclude_products(spark, root):
    return _products_excluded(spark, root, *tpch.ALL_COLUMNS)


def excluded_check(spark, root):
    """Rows of the excluded product in all rows and in those that are left, where none may be."""
    named = tpch.transactions(spark, root, ("PROD_NAME",), fx.GAPS)
    counts = [
        cleaning.only_products(rows, fx.EXCLUDED).agg(F.count(F.lit(1)).alias(name))
        for rows, name in (
            (named, "n_excluded"),
            (cleaning.exclude_products(named, fx.EXCLUDED), "n_remaining"),
        )
    ]
    return counts[0].withColumn("n_remaining", counts[1].scalar())


def exclude_customers(spark, root):
    txns = tpch.transactions(spark, root)
    return cleaning.exclude_customers(txns, [fx.OUTLIER_CARD])


def clean_transactions(spark, root):
    return _clean(spark, root, *tpch.ALL_COLUMNS)


_OUTLIER_COLUMNS = ("TXN_ID", CARD, "PROD_NAME", "PROD_QTY", "DATE")


def qty_outliers(spark, root):
    txns = _products_excluded(spark, root, *_OUTLIER_COLUMNS)
    return txns.filter(F.col("PROD_QTY") == fx.OUTLIER_QTY).select(*_OUTLIER_COLUMNS)


def outlier_customer_txns(spark, root):
    txns = _products_excluded(spark, root, *_OUTLIER_COLUMNS)
    return txns.filter(F.col(CARD) == fx.OUTLIER_CARD).select(*_OUTLIER_COLUMNS)


def outlier_cards(spark, root):
    """The cards that stand out once the fixture's rule makes one of them buy far too much."""
    txns = _products_excluded(spark, root, CARD, "PROD_QTY")
    planted = F.when(F.col(CARD) == fx.OUTLIER_CARD, F.col("PROD_QTY") * fx.OUTLIER_FACTOR)
    found = outliers.outlier_cards(txns.withColumn("PROD_QTY", planted.otherwise(F.col("PROD_QTY"))))
    return fixed(found, units=2, largest=2, median=2)


# --- loyalty cards and repeats ----------------------------------------------------------


def distinct_cards(spark, root):
    return _products_excluded(spark, root, CARD).select(CARD).distinct()


def _gapped(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """Transactions with missing cards and names and with unknown cards, by the fixture's rule."""
    return tpch.transactions(spark, root, columns, fx.GAPS)


def _gapped_kept(spark, root, *columns):
    return cleaning.exclude_products(_gapped(spark, root, *columns, "PROD_NAME"), fx.EXCLUDED)


def repeat_customers_top50(spark, root):
    return profiling.repeats(_gapped_kept(spark, root, CARD), CARD, top=50)


def repeat_txns_top10(spark, root):
    return profiling.repeats(_gapped_kept(spark, root, "TXN_ID"), "TXN_ID", top=10)


def repeat_card_txn(spark, root):
    return profiling.repeats(_gapped_kept(spark, root, CARD, "TXN_ID"), CARD, "TXN_ID")


# --- summaries --------------------------------------------------------------------------

_NUMERIC = ("DATE", "STORE_NBR", CARD, "TXN_ID", "PROD_QTY", "TOT_SALES")


def numeric_summary(spark, root):
    txns = _clean(spark, root, *_NUMERIC)
    return fixed(quantiles.numeric_summary(txns, _NUMERIC), mean=4)


def numeric_summary_uncleaned(spark, root):
    txns = _products_excluded(spark, root, *_NUMERIC)
    return fixed(quantiles.numeric_summary(txns, _NUMERIC), mean=4)


def numeric_summary_year(spark, root):
    """The summary of a year's months, from sketches that are stored per month."""
    txns = _products_excluded(spark, root, *_NUMERIC).withColumn("YEARMONTH", yearmonth(F.col("DATE")))
    base = stage(quantiles.naturals(txns, _NUMERIC, by=["YEARMONTH"]))
    state = stage(quantiles.sketch_state(base, _NUMERIC, by=["YEARMONTH"]))
    summary = quantiles.summary_of_parts(base, state, _NUMERIC, "YEARMONTH", fx.YEAR_MONTHS)
    return fixed(summary, mean=4)


def customer_summary(spark, root):
    return fixed(quantiles.numeric_summary(tpch.customers(spark, root), [CARD]), mean=4)


def text_summary(spark, root):
    """Text columns of both tables."""
    txns = profiling.text_summary(tpch.transactions(spark, root)).select(F.lit("transactions").alias("table"), "*")
    people = profiling.text_summary(tpch.customers(spark, root))
    return txns.union(people.select(F.lit("customers").alias("table"), "*"))


# --- days -------------------------------------------------------------------------------


def daily_counts(spark, root):
    return profiling.daily_counts(_clean(spark, root, "DATE")).orderBy(*smallest_first("DATE"))


def calendar_days(spark, root):
    return calendar_of(tpch.transactions(spark, root, ("DATE",)))


def _calendar(spark):
    return calendar_between(spark, fx.FIRST_DAY, fx.LAST_DAY)


def _on_calendar(spark, root):
    daily = profiling.daily_counts(_clean(spark, root, "DATE"))
    return profiling.on_calendar(daily, _calendar(spark))


def daily_counts_calendar(spark, root):
    return _on_calendar(spark, root).orderBy(*smallest_first("DATE"))


def daily_counts_month(spark, root):
    days = _on_calendar(spark, root)
    return days.filter(F.month("DATE") == fx.DECEMBER).orderBy(*smallest_first("DATE"))


def missing_days(spark, root):
    days = _clean(spark, root, "DATE")
    return profiling.missing_days(days, _calendar(spark)).orderBy(*smallest_first("DATE"))


def date_coverage(spark, root):
    return profiling.date_coverage(_clean(spark, root, "DATE"))


# --- product features -------------------------------------------------------------------


def product_features(spark, root):
    return _featured(spark, root, *tpch.ALL_COLUMNS)


def _merged(spark, root, *sums):
    """Cleaned transactions merged by product: first by key, then, with the names, by name."""
    totals = tpch.product_totals(spark, root, sums, [fx.OUTLIER_CARD])
    return profiling.merge_products(cleaning.exclude_products(totals, fx.EXCLUDED), *sums, weight="n")


def _names(spark, root):
    return _merged(spark, root).select("PROD_NAME")


def _products(spark, root, *sums):
    """Product features on rows merged by product name."""
    return cleaning.product_features(_merged(spark, root, *sums), fx.BRAND_ALIASES)


def brand_raw(spark, root):
    return cleaning.with_raw_brand(_names(spark, root))


def brand_cleaned(spark, root):
    raw = cleaning.with_raw_brand(_names(spark, root)).select("BRAND").distinct()
    kept = raw.withColumn("raw", F.col("BRAND"))
    return cleaning.unify_brands(kept, fx.BRAND_ALIASES).select("raw", "BRAND")


def _respelt(spark, root):
    """Product names with some first words shortened by the fixture's rule, so that there are aliases to be found."""
    named = cleaning.product_features(_merged(spark, root), {})
    brand, size = F.col("BRAND"), F.col("PACK_SIZE")
    short = F.when(size % fx.BARE_PACKS == 0, aliases.skeleton(brand)).when(
        size % fx.CUT_PACKS == 0, F.expr("left(BRAND, length(BRAND) - 1)")
    )
    rest = F.substr("PROD_NAME", F.length(brand) + 1)
    return named.select(F.concat(F.coalesce(short, brand), rest).alias("PROD_NAME"), "n")


def brand_aliases_proposed(spark, root):
    return aliases.propose(_respelt(spark, root))


def brand_aliases_resolved(spark, root):
    return aliases.resolved(aliases.propose(_respelt(spark, root)))


def distinct_brands(spark, root):
    named = cleaning.product_features(_names(spark, root), fx.BRAND_ALIASES)
    return named.select("BRAND").distinct()


def pack_size_counts(spark, root):
    sizes = _products(spark, root).groupBy("PACK_SIZE").agg(F.sum("n").alias("count"))
    return sizes.orderBy(largest_first("PACK_SIZE"))


def brand_counts(spark, root):
    return profiling.counts(cleaning.with_raw_brand(_merged(spark, root)), "BRAND", weight="n")


def brand_units(spark, root):
    return fixed(profiling.units_by(_products(spark, root, "PROD_QTY"), "BRAND"))


def pack_size_histogram(spark, root):
    products = _products(spark, root)
    return fixed(distribution.histogram(products, "PACK_SIZE", bins=30, weight="n"))


def unit_price(spark, root):
    priced = cleaning.with_price(_clean(spark, root, "TXN_ID", "PROD_NAME", "PROD_QTY", "TOT_SALES"))
    return priced.select("TXN_ID", "PROD_NAME", "price")


# --- customers and the join -------------------------------------------------------------


def customers_by_lifestage(spark, root):
    return profiling.counts(tpch.customers(spark, root), "LIFESTAGE")


def customers_by_premium(spark, root):
    return profiling.counts(tpch.customers(spark, root), "PREMIUM_CUSTOMER")


def distinct_lifestages(spark, root):
    return tpch.customers(spark, root).select("LIFESTAGE").distinct()


def distinct_premium_types(spark, root):
    return tpch.customers(spark, root).select("PREMIUM_CUSTOMER").distinct()


def enriched_transactions(spark, root):
    return _enriched(spark, root, *tpch.ALL_COLUMNS)


def enriched_inner(spark, root):
    """The join as an inner one: rows without a customer drop out."""
    featured = cleaning.product_features(
        cleaning.exclude_products(_gapped(spark, root, *tpch.ALL_COLUMNS), fx.EXCLUDED), fx.BRAND_ALIASES
    )
    return segments.enrich(featured, tpch.customers(spark, root), how="inner").select(
        *tables.ENRICHED.names
    )


def enriched_handoff(spark, root):
    """Write the enriched table by month, read it back and total its months."""
    path = staging_path(spark)
    tables.write_enriched(_enriched(spark, root, *tpch.ALL_COLUMNS), path)
    months = tables.read_enriched(spark, path).groupBy("YEARMONTH")
    totals = months.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("TOT_SALES").alias("totSales"),
        F.sum("PROD_QTY").alias("units"),
    )
    return fixed(totals, totSales=2)


def null_counts(spark, root):
    featured = cleaning.product_features(_gapped(spark, root, *tpch.ALL_COLUMNS), fx.BRAND_ALIASES)
    return profiling.null_counts(segments.enrich(featured, tpch.customers(spark, root)))


def join_quality(spark, root):
    return profiling.join_quality(_gapped(spark, root, CARD), tpch.customers(spark, root))


# --- segments ---------------------------------------------------------------------------


def _segments(spark, root):
    totals = segments.card_totals(_clean(spark, root, "PROD_QTY", "TOT_SALES"))
    return segments.segment_metrics(segments.enrich(totals, tpch.customers(spark, root)))


def segment_sales(spark, root):
    sales = _segments(spark, root).select(*segments.SEGMENT, "SALES")
    return fixed(sales, SALES=2).orderBy(largest_first("SALES"), *segments.SEGMENT)


def segment_customers(spark, root):
    found = _segments(spark, root).select(*segments.SEGMENT, "CUSTOMERS")
    return found.orderBy(largest_first("CUSTOMERS"), *segments.SEGMENT)


def _segment_average(spark, root, column):
    chosen = _segments(spark, root).select(*segments.SEGMENT, F.col(column).alias("AVG"))
    return fixed(chosen).orderBy(largest_first("AVG"), *segments.SEGMENT)


def segment_units_per_customer(spark, root):
    return _segment_average(spark, root, "UNITS_PER_CUSTOMER")


def segment_avg_price(spark, root):
    return _segment_average(spark, root, "PRICE_PER_UNIT")


def segment_avg_price_top6(spark, root):
    return _segment_average(spark, root, "PRICE_PER_UNIT").limit(6)


def segment_sales_share(spark, root):
    return fixed(segments.segment_shares(_segments(spark, root), "SALES"), SALES=2)


def segment_customer_share(spark, root):
    return fixed(segments.segment_shares(_segments(spark, root), "CUSTOMERS"))


# --- prices -----------------------------------------------------------------------------


def price_ttest(spark, root):
    priced = cleaning.with_price(_clean(spark, root, "PROD_QTY", "TOT_SALES"))
    per_card = inference.value_moments(priced, "price", CARD)
    chosen = segments.enrich(per_card, tpch.customers(spark, root)).filter(
        F.col("LIFESTAGE").isin(list(fx.TTEST_LIFESTAGES))
    )
    mainstream = F.col("PREMIUM_CUSTOMER") == fx.PREMIUM
    tested = inference.welch_of_moments(chosen, mainstream, ~mainstream)
    # The logarithm shows a small p-value to the same relative precision as a large one.
    return fixed(tested.withColumn("p_log10", F.log10("p_value")), df=4, ci_low=4)


def price_by_group_sample(spark, root):
    priced = cleaning.with_price(_clean(spark, root, "TXN_ID", "PROD_NAME", "PROD_QTY", "TOT_SALES"))
    return segments.first_priced_rows(priced, tpch.customers(spark, root))


def price_histogram_by_group(spark, root):
    priced = cleaning.with_price(_clean(spark, root, "PROD_QTY", "TOT_SALES"))
    merged = priced.groupBy(CARD, "price").agg(F.count(F.lit(1)).alias("n"))
    grouped = segments.with_price_group(segments.enrich(merged, tpch.customers(spark, root)))
    return fixed(distribution.histogram(grouped, "price", 9, by="GROUP", weight="n"))


# --- affinity ---------------------------------------------------------------------------


def _affinity(spark, root, by):
    per_card = tpch.card_part_units(spark, root, fx.EXCLUDED, [fx.OUTLIER_CARD])
    enriched = segments.enrich(per_card, tpch.customers(spark, root))
    per_part = aff.segment_units(
        enriched,
        tpch.PART,
        aff.in_target(fx.LIFESTAGE, fx.PREMIUM),
        aff.in_comparison(fx.LIFESTAGE, fx.PREMIUM),
    )
    units = tpch.with_names(spark, root, per_part)
    return fixed(aff.affinity_of_units(cleaning.product_features(units, fx.BRAND_ALIASES), by))


def brand_affinity(spark, root):
    return _affinity(spark, root, "BRAND")


def pack_affinity(spark, root):
    return _affinity(spark, root, "PACK_SIZE")


def products_of_pack_size(spark, root):
    named = cleaning.product_features(_names(spark, root), fx.BRAND_ALIASES)
    return aff.products_of_pack_size(named, fx.PACK_SIZE)


QUERIES = [
    load_transactions,
    load_customers,
    schema_profile,
    customer_schema_profile,
    excel_serial_dates,
    product_counts,
    product_words,
    exclude_products,
    excluded_check,
    exclude_customers,
    clean_transactions,
    qty_outliers,
    outlier_customer_txns,
    outlier_cards,
    distinct_cards,
    repeat_customers_top50,
    repeat_txns_top10,
    repeat_card_txn,
    numeric_summary,
    numeric_summary_uncleaned,
    numeric_summary_year,
    customer_summary,
    text_summary,
    daily_counts,
    calendar_days,
    daily_counts_calendar,
    daily_counts_month,
    missing_days,
    date_coverage,
    product_features,
    brand_raw,
    brand_cleaned,
    brand_aliases_proposed,
    brand_aliases_resolved,
    distinct_brands,
    pack_size_counts,
    brand_counts,
    brand_units,
    pack_size_histogram,
    unit_price,
    customers_by_lifestage,
    customers_by_premium,
    distinct_lifestages,
    distinct_premium_types,
    enriched_transactions,
    enriched_inner,
    enriched_handoff,
    null_counts,
    join_quality,
    segment_sales,
    segment_customers,
    segment_units_per_customer,
    segment_avg_price,
    segment_avg_price_top6,
    segment_sales_share,
    segment_customer_share,
    price_ttest,
    price_by_group_sample,
    price_histogram_by_group,
    brand_affinity,
    pack_affinity,
    products_of_pack_size,
]
