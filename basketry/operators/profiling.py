"""Counts, coverage and quality checks on transactions and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.text import has_digit, has_letter, tokens
from basketry.functions.values import is_missing, largest_first, smallest_first
from basketry.operators.distribution import numbered


def counts(
    df: DataFrame, *keys: str, name: str = "count", weight: str | None = None
) -> DataFrame:
    """Rows per group, largest first, ties by key; ``weight`` holds the rows of merged ones."""
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    grouped = df.groupBy(*keys).agg(rows.alias(name))
    return grouped.orderBy(largest_first(name), *smallest_first(*keys))


def merge_products(txns: DataFrame, *sums: str, weight: str | None = None) -> DataFrame:
    """Rows ``n`` and the given sums per product name; ``weight`` holds the rows of merged ones.

    Product features depend on the name alone, so a report by brand or size derives them
    from these few rows instead of from every transaction.
    """
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return txns.groupBy("PROD_NAME").agg(rows.alias("n"), *[F.sum(c).alias(c) for c in sums])


def repeats(df: DataFrame, *keys: str, top: int | None = None) -> DataFrame:
    """Groups with more than one row, largest first; ``top`` asks for the leading rows only."""
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).filter("count > 1")
    ranked = grouped.orderBy(largest_first("count"), *smallest_first(*keys))
    return ranked if top is None else ranked.limit(top)


def word_counts(txns: DataFrame) -> DataFrame:
    """How often each word occurs in the distinct product names; words with digits are left out."""
    names = txns.select(F.col("PROD_NAME").cast("string").alias("PROD_NAME")).distinct()
    words = names.select(F.explode(tokens(F.col("PROD_NAME"))).alias("Words"))
    kept = words.filter(~has_digit(F.col("Words")) & has_letter(F.col("Words")))
    return counts(kept, "Words", name="Count")


def units_by(df: DataFrame, key: str) -> DataFrame:
    """Units per group with their rank, largest first, ties by key."""
    units = df.groupBy(key).agg(F.sum("PROD_QTY").alias("units"))
    return numbered(units, [largest_first("units"), *smallest_first(key)], "rank")


def daily_counts(txns: DataFrame) -> DataFrame:
    """Rows per day. The caller sorts where the order matters."""
    return txns.groupBy("DATE").agg(F.count(F.lit(1)).alias("count"))


def on_calendar(daily: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every calendar day with its count; days without transactions have a missing count."""
    return daily.join(calendar, "DATE", "right").select("DATE", "count")


def missing_days(txns: DataFrame, calendar: DataFrame) -> DataFrame:
    return calendar.join(txns.select("DATE").distinct(), "DATE", "left_anti")


def date_coverage(txns: DataFrame) -> DataFrame:
    """First and last day, number of days present, expected and missing."""
    days = txns.agg(
        F.min("DATE").alias("first_day"),
        F.max("DATE").alias("last_day"),
        F.count_distinct("DATE").alias("n_days"),
    )
    expected = (F.datediff("last_day", "first_day") + 1).cast("bigint")
    return days.withColumn("n_expected", expected).withColumn(
        "n_missing", F.col("n_expected") - F.col("n_days")
    )


def schema_profile(df: DataFrame) -> DataFrame:
    """Columns with their type and the number of observations."""
    listing = F.array(
        *[F.struct(F.lit(n).alias("column"), F.lit(t).alias("type")) for n, t in df.dtypes]
    )
    sized = df.agg(F.count(F.lit(1)).alias("n_obs"))
    return sized.select(F.explode(listing).alias("c"), "n_obs").select("c.*", "n_obs")


def text_summary(df: DataFrame) -> DataFrame:
    """Length and class of every text column: what a summary shows of text."""
    names = [n for n, t in df.dtypes if t == "string"]
    listing = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    sized = df.agg(F.count(F.lit(1)).alias("length"))
    return sized.select(
        F.explode(listing).alias("column"), "length", F.lit("character").alias("class")
    )


def null_counts(df: DataFrame) -> DataFrame:
    """Missing cells per column and in total, from one pass over the rows."""
    per_column = df.agg(*[F.count_if(is_missing(df, c)).alias(c) for c in df.columns])
    total = sum((F.col(c) for c in df.columns), F.lit(0))
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null")) for c in df.columns]
    cells.append(F.struct(F.lit("(total)").alias("column"), total.alias("n_null")))
    return per_column.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def join_quality(txns: DataFrame, customers: DataFrame, key: str = "LYLTY_CARD_NBR") -> DataFrame:
    """Rows before and after the customer join and rows without a customer.

    Both sides are counted per key first, so one heavy card is a single row in the join.
    """
    left = txns.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    right = customers.groupBy(key).agg(F.count(F.lit(1)).alias("matches"))
    both = left.join(right, key, "left")
    return both.agg(
        F.sum("n").alias("n_left"),
        F.sum(F.col("n") * F.coalesce("matches", F.lit(1))).alias("n_joined"),
        F.sum(F.when(F.col("matches").isNull(), F.col("n")).otherwise(0)).alias("n_unmatched"),
    )
