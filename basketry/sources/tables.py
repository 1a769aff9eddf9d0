"""Contract schemas, readers for CSV and parquet, and the enriched hand-off table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.functions.dates import serial_to_date, yearmonth

TRANSACTIONS = T.StructType(
    [
        T.StructField("DATE", T.DateType()),
        T.StructField("STORE_NBR", T.LongType()),
        T.StructField("LYLTY_CARD_NBR", T.LongType()),
        T.StructField("TXN_ID", T.LongType()),
        T.StructField("PROD_NAME", T.StringType()),
        T.StructField("PROD_QTY", T.DoubleType()),
        T.StructField("TOT_SALES", T.DoubleType()),
    ]
)

CUSTOMERS = T.StructType(
    [
        T.StructField("LYLTY_CARD_NBR", T.LongType()),
        T.StructField("LIFESTAGE", T.StringType()),
        T.StructField("PREMIUM_CUSTOMER", T.StringType()),
    ]
)

ENRICHED = T.StructType(
    TRANSACTIONS.fields
    + [T.StructField("PACK_SIZE", T.DoubleType()), T.StructField("BRAND", T.StringType())]
    + CUSTOMERS.fields[1:]
)


def _open(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    if fmt == "csv":
        # Columns are matched by header name and cast to the contract; nothing is inferred.
        return spark.read.option("header", True).option("nullValue", "NA").csv(path)
    return spark.read.format(fmt).load(path)


def _conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the contract columns by name. A malformed value raises, under any session setting."""

    def checked(field: T.StructField) -> Column:
        value = F.col(field.name)
        if df.schema[field.name].dataType == field.dataType:
            return value
        cast = value.try_cast(field.dataType)
        wrong = F.concat(F.lit(f"malformed {field.name}: "), value.cast("string"))
        return F.when(value.isNotNull() & cast.isNull(), F.raise_error(wrong)).otherwise(cast)

    return df.select([checked(f).alias(f.name) for f in schema.fields])


def read_transactions(
    spark: SparkSession, path: str, fmt: str = "parquet", serial_dates: bool = False
) -> DataFrame:
    """Transactions; ``serial_dates`` marks a DATE column of spreadsheet day serials."""
    raw = _open(spark, path, fmt)
    if serial_dates:
        raw = raw.withColumn("DATE", serial_to_date(F.col("DATE")))
    return _conform(raw, TRANSACTIONS)


def read_customers(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return _conform(_open(spark, path, fmt), CUSTOMERS)


def write_enriched(enriched: DataFrame, path: str) -> None:
    """Write the enriched table by month.

    The rebalance hint gives each month few files and lets adaptive execution split a month
    that holds far more rows than the others.
    """
    keyed = enriched.select(ENRICHED.names).withColumn("YEARMONTH", yearmonth(F.col("DATE")))
    keyed.hint("rebalance", "YEARMONTH").write.mode("overwrite").partitionBy(
        "YEARMONTH"
    ).parquet(path)


def read_enriched(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Enriched transactions with their month key; a month filter prunes folders."""
    if fmt == "parquet":
        stored = T.StructType(ENRICHED.fields + [T.StructField("YEARMONTH", T.IntegerType())])
        return spark.read.schema(stored).parquet(path)
    rows = _conform(_open(spark, path, fmt), ENRICHED)
    return rows.withColumn("YEARMONTH", yearmonth(F.col("DATE")))
