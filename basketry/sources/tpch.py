"""Adapter: the given star-schema tables seen through the retail contract.

Only the joins that the asked columns need are put into the plan. All joins are left joins
on the lines, so the row count never depends on the chosen columns.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.sources.tables import TRANSACTIONS

ALL_COLUMNS = tuple(TRANSACTIONS.names)

# The key of a product, where lines are added up before they meet its name.
PART = "_part"


# The columns that are read. A stated schema spares a look into the files for every query.
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, "
    "l_extendedprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "part": "p_partkey bigint, p_name string, p_size int",
    "customer": "c_custkey bigint, c_mktsegment string, c_acctbal double",
}


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}.parquet")


@dataclass(frozen=True)
class Gaps:
    """A rule that makes some values missing or unknown; no row is dropped.

    Cards are missing where the order key is a multiple of ``card``, and negative, which no customer
    has, where the card is a multiple of ``unknown``; names are missing where the part key is a
    multiple of ``name``.
    """

    card: int
    unknown: int
    name: int


def _premium(balance: Column) -> Column:
    return (
        F.when(balance < 2500, "Budget")
        .when(balance < 7000, "Mainstream")
        .when(balance.isNotNull(), "Premium")
    )


def _parts(spark: SparkSession, root: str) -> DataFrame:
    name = F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit("g"))
    return table(spark, root, "part").select(F.col("p_partkey").alias("_part"), name.alias("PROD_NAME"))


def _lines(spark: SparkSession, root: str, wanted: set[str]) -> DataFrame:
    df = table(spark, root, "lineitem").select(
        F.col("l_orderkey").alias("TXN_ID"),
        F.col("l_partkey").alias("_part"),
        F.col("l_suppkey").alias("STORE_NBR"),
        F.col("l_quantity").alias("PROD_QTY"),
        F.col("l_extendedprice").alias("TOT_SALES"),
    )
    if wanted & {"DATE", "LYLTY_CARD_NBR"}:
        orders = table(spark, root, "orders").select(
            F.col("o_orderkey").alias("TXN_ID"),
            F.col("o_custkey").alias("LYLTY_CARD_NBR"),
            F.col("o_orderdate").cast("date").alias("DATE"),
        )
        df = df.join(orders, "TXN_ID", "left")
    return df


def transactions(
    spark: SparkSession,
    root: str,
    columns: tuple[str, ...] = ALL_COLUMNS,
    gaps: Gaps | None = None,
    without: str | None = None,
) -> DataFrame:
    """One row per line item with the asked contract columns.

    ``without`` leaves out the lines of parts whose name contains it; lines of unknown parts stay.
    """
    wanted = set(columns)
    df = _lines(spark, root, wanted)
    if without is not None:
        excluded = _parts(spark, root).filter(F.col("PROD_NAME").contains(without)).select("_part")
        df = df.join(excluded, "_part", "left_anti")
    if "PROD_NAME" in wanted:
        df = df.join(_parts(spark, root), "_part", "left")
    if gaps:
        missing = F.when(F.col("TXN_ID") % gaps.card != 0, 1)
        card, name = F.col("LYLTY_CARD_NBR"), F.col("PROD_NAME")
        if "LYLTY_CARD_NBR" in df.columns:
            known = F.when(card % gaps.unknown == 0, -card).otherwise(card)
            df = df.withColumn("LYLTY_CARD_NBR", F.when(missing == 1, known))
        if "PROD_NAME" in df.columns:
            df = df.withColumn("PROD_NAME", F.when(F.col("_part") % gaps.name != 0, name))
    return df.select([c for c in ALL_COLUMNS if c in wanted])


def product_totals(
    spark: SparkSession, root: str, sums: tuple[str, ...] = (), cards: Iterable[int] = ()
) -> DataFrame:
    """PROD_NAME, rows ``n`` and the given sums per part key, without the lines of ``cards``.

    The lines are added up per key before they meet the names, so a heavy product is one row in
    that join. A card that is missing is left out with the cards, as in ``exclude_customers``.
    """
    cards = list(cards)
    lines = _lines(spark, root, {"LYLTY_CARD_NBR"} if cards else set())
    if cards:
        lines = lines.filter(~F.col("LYLTY_CARD_NBR").isin(cards))
    totals = lines.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums])
    return totals.join(_parts(spark, root), "_part", "left").select("PROD_NAME", "n", *sums)


def card_part_units(
    spark: SparkSession, root: str, without: str, cards: Iterable[int] = ()
) -> DataFrame:
    """Units per card and part key, without the parts whose name contains ``without`` and without ``cards``.

    The tasks add up a heavy card before anything is moved, and no name is read per line.
    """
    lines = _lines(spark, root, {"LYLTY_CARD_NBR"})
    kept = lines.filter(~F.col("LYLTY_CARD_NBR").isin(list(cards)))
    excluded = _parts(spark, root).filter(F.col("PROD_NAME").contains(without)).select(PART)
    units = kept.groupBy("LYLTY_CARD_NBR", PART).agg(F.sum("PROD_QTY").alias("PROD_QTY"))
    return units.join(excluded, PART, "left_anti")


def with_names(spark: SparkSession, root: str, per_part: DataFrame) -> DataFrame:
    """PROD_NAME in place of the part key."""
    return per_part.join(_parts(spark, root), PART, "left").drop(PART)


def customers(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "customer").select(
        F.col("c_custkey").alias("LYLTY_CARD_NBR"),
        F.col("c_mktsegment").alias("LIFESTAGE"),
        _premium(F.col("c_acctbal")).alias("PREMIUM_CUSTOMER"),
    )
