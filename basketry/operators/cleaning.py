"""Row filters and derived product columns. All of them are narrow: no shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.text import first_number, first_word_upper, lacks

# Brand spellings and the brand they stand for.
BRAND_ALIASES = {
    "RRD": "RED",
    "WW": "WOOLWORTHS",
    "DORITO": "DORITOS",
    "SNBTS": "SUNBITES",
    "INFZNS": "INFUZIONS",
    "SMITH": "SMITHS",
    "GRAIN": "GRNWVES",
    "NCC": "NATURAL",
}

# The product word and the loyalty card that are left out.
EXCLUDED_PRODUCT = "Salsa"
OUTLIER_CARD = 226000


def exclude_products(txns: DataFrame, part: str = EXCLUDED_PRODUCT) -> DataFrame:
    return txns.filter(lacks(F.col("PROD_NAME"), part))


def only_products(txns: DataFrame, part: str = EXCLUDED_PRODUCT) -> DataFrame:
    return txns.filter(F.col("PROD_NAME").contains(part))


def exclude_customers(txns: DataFrame, cards: Iterable[int] = (OUTLIER_CARD,)) -> DataFrame:
    """Drop the given cards. A row without a card is dropped too, as a comparison with it is unknown."""
    return txns.filter(~F.col("LYLTY_CARD_NBR").isin(list(cards)))


def clean_transactions(
    txns: DataFrame, part: str = EXCLUDED_PRODUCT, cards: Iterable[int] = (OUTLIER_CARD,)
) -> DataFrame:
    return exclude_customers(exclude_products(txns, part), cards)


def unify_brands(df: DataFrame, aliases: Mapping[str, str] = BRAND_ALIASES) -> DataFrame:
    return df.replace(dict(aliases), subset=["BRAND"])


def with_raw_brand(df: DataFrame) -> DataFrame:
    return df.withColumn("BRAND", first_word_upper(F.col("PROD_NAME")))


def product_features(df: DataFrame, aliases: Mapping[str, str] = BRAND_ALIASES) -> DataFrame:
    """Add PACK_SIZE (first number of the name) and BRAND (first word, spellings unified)."""
    sized = df.withColumn("PACK_SIZE", first_number(F.col("PROD_NAME")))
    return unify_brands(with_raw_brand(sized), aliases)


def with_price(df: DataFrame) -> DataFrame:
    return df.withColumn("price", F.try_divide("TOT_SALES", "PROD_QTY"))
