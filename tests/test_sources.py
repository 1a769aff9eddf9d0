"""Readers and the month-partitioned hand-off table."""

import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from basketry import session
from basketry.operators.cleaning import product_features
from basketry.operators.segments import enrich
from basketry.sources import tables, tpch


def test_csv_with_serial_dates_missing_tokens_and_extra_columns(spark, tmp_path):
    path = tmp_path / "transactions.csv"
    path.write_text(
        "DATE,STORE_NBR,LYLTY_CARD_NBR,TXN_ID,PROD_NBR,PROD_NAME,PROD_QTY,TOT_SALES\n"
        '43390,1,1000,1,5,"Natural Chip, Co 175g",2,6\n'
        "43391,1,NA,2,66,NA,3,6.3\n"
    )
    got = tables.read_transactions(spark, str(path), "csv", serial_dates=True)
    assert got.schema == tables.TRANSACTIONS
    first, second = got.orderBy("TXN_ID").collect()
    assert first.DATE == dt.date(2018, 10, 17) and first.PROD_NAME == "Natural Chip, Co 175g"
    assert second.LYLTY_CARD_NBR is None and second.PROD_NAME is None and second.TOT_SALES == 6.3


def test_customers_csv_and_parquet(spark, tmp_path):
    path = tmp_path / "customers.csv"
    path.write_text("PREMIUM_CUSTOMER,LYLTY_CARD_NBR,LIFESTAGE\nBudget,5,RETIREES\n")
    got = tables.read_customers(spark, str(path))
    assert [tuple(r) for r in got.collect()] == [(5, "RETIREES", "Budget")]
    got.write.parquet(str(tmp_path / "customers"))
    assert tables.read_customers(spark, str(tmp_path / "customers"), "parquet").collect() == got.collect()


def test_handoff_round_trip_and_pruning(spark, tiny, tmp_path):
    txns = product_features(tpch.transactions(spark, tiny))
    enriched = enrich(txns, tpch.customers(spark, tiny))
    path = str(tmp_path / "enriched")
    tables.write_enriched(enriched, path)
    back = tables.read_enriched(spark, path)
    assert back.count() == enriched.count()
    names = tables.ENRICHED.names
    assert back.select(names).exceptAll(enriched.select(names)).count() == 0
    month = back.filter(F.col("YEARMONTH") == 199705)
    plan = month._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(YEARMONTH" in plan
    assert month.count() == enriched.filter("year(DATE) = 1997 and month(DATE) = 5").count()


def test_enriched_csv(spark, tmp_path):
    path = tmp_path / "enriched.csv"
    path.write_text(
        "LYLTY_CARD_NBR,DATE,STORE_NBR,TXN_ID,PROD_NAME,PROD_QTY,TOT_SALES,PACK_SIZE,BRAND,LIFESTAGE,PREMIUM_CUSTOMER\n"
        "1000,2018-10-17,1,1,Natural 175g,2,6,175,NATURAL,RETIREES,Premium\n"
    )
    row = tables.read_enriched(spark, str(path), "csv").first()
    assert (row.DATE, row.YEARMONTH, row.PACK_SIZE) == (dt.date(2018, 10, 17), 201810, 175.0)


def test_adapter_row_count_is_independent_of_columns(spark, tiny):
    lines = tpch.table(spark, tiny, "lineitem").count()
    for columns in (("TOT_SALES",), ("DATE",), ("PROD_NAME",), tpch.ALL_COLUMNS):
        df = tpch.transactions(spark, tiny, columns)
        assert df.count() == lines and set(df.columns) == set(columns)


def settings(folder, master):
    """Stands in for a session with the given settings."""
    conf = SimpleNamespace(get=lambda key, default: folder if folder else default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_staging_folder():
    named = settings("hdfs://shared/check/", "spark://host:7077")
    assert session.staging_path(named).startswith("hdfs://shared/check/basketry-")
    assert session.staging_path(named, "s3a://own").startswith("s3a://own/basketry-")
    assert "/basketry-" in session.staging_path(settings(None, "local[4]"))
    for master in ("spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.staging_path(settings(None, master))


def test_staged_table_has_the_same_rows(spark):
    df = spark.range(100).withColumn("x", F.col("id") / 3)
    staged = session.stage(df)
    assert staged.schema.names == ["id", "x"] and staged.exceptAll(df).count() == 0
    assert "parquet" in staged._jdf.queryExecution().executedPlan().toString().lower()



def test_gaps_drop_no_row(spark, tiny):
    plain = tpch.transactions(spark, tiny)
    gapped = tpch.transactions(spark, tiny, gaps=tpch.Gaps(card=89, unknown=31, name=97))
    assert gapped.count() == plain.count()
    r = gapped.agg(
        F.count_if(F.col("LYLTY_CARD_NBR").isNull()).alias("card"),
        F.count_if(F.col("LYLTY_CARD_NBR") < 0).alias("unknown"),
        F.count_if(F.col("PROD_NAME").isNull()).alias("name"),
    ).first()
    assert r.card > 0 and r.unknown > 0 and r.name > 0


def test_exclusion_by_key_equals_exclusion_by_name(spark, tiny):
    by_key = tpch.transactions(spark, tiny, ("TXN_ID", "TOT_SALES"), without="gizmo")
    named = tpch.transactions(spark, tiny, ("TXN_ID", "TOT_SALES", "PROD_NAME"))
    by_name = named.filter(F.col("PROD_NAME").isNull() | ~F.col("PROD_NAME").contains("gizmo")).drop("PROD_NAME")
    assert by_key.exceptAll(by_name).isEmpty() and by_name.exceptAll(by_key).isEmpty()


def test_balance_without_value_has_no_type(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([(1, "A", None), (2, "A", 9000.0)], tpch.SCHEMAS["customer"]).write.parquet(f"{path}/customer.parquet")
    got = {r.LYLTY_CARD_NBR: r.PREMIUM_CUSTOMER for r in tpch.customers(spark, path).collect()}
    assert got == {1: None, 2: "Premium"}


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_malformed_values_raise(spark, tmp_path, ansi):
    path = tmp_path / "customers.csv"
    path.write_text("LYLTY_CARD_NBR,LIFESTAGE,PREMIUM_CUSTOMER\nabc,RETIREES,Premium\n")
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception, match="malformed LYLTY_CARD_NBR: abc"):
            tables.read_customers(spark, str(path)).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
