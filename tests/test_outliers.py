"""Outlier cards by exact median and median absolute deviation."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from basketry.operators import outliers, quantiles

SCHEMA = "LYLTY_CARD_NBR bigint, PROD_QTY int"


def test_the_card_of_the_original_run_is_found(spark):
    """Two lines of 200 units among cards that buy, as there, mostly two and rarely up to five a line."""
    usual = spark.range(60_000).select(
        (1000 + F.pmod(F.xxhash64("id"), F.lit(7000))).alias("LYLTY_CARD_NBR"),
        F.when(F.col("id") % 10 == 0, 1).when(F.col("id") % 601 == 0, 5).otherwise(2).cast("int").alias("PROD_QTY"),
    )
    planted = spark.createDataFrame([(226000, 200), (226000, 200)], SCHEMA)
    lines = usual.union(planted)
    middle = statistics.median(r[0] for r in lines.select("PROD_QTY").collect())
    assert middle == 2  # and the deviation of more than half of the lines from it is 0
    found = outliers.outlier_cards(lines).collect()
    assert [(r.LYLTY_CARD_NBR, r.n_lines, r.units, r.largest) for r in found] == [(226000, 2, 400.0, 200.0)]


@pytest.mark.parametrize("seed", range(3))
def test_centre_and_spread_equal_plain_ones(spark, seed):
    rng = random.Random(seed)
    values = [rng.choice([rng.gauss(0, 5), rng.randint(-3, 3), 1e6]) for _ in range(rng.choice([1, 2, 501]))]
    base = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    centre, spread = outliers.centre_and_spread(quantiles.naturals(base, ["x"]), "x")
    middle = statistics.median(values)
    mad = statistics.median(abs(v - middle) for v in values)
    assert centre == pytest.approx(middle)
    assert spread == pytest.approx(mad * 1.482602218505602)


def test_mean_deviation_where_most_cards_are_equal(spark):
    rows = [(c, 4) for c in range(200)] + [(900, 4), (900, 500)] + [(901, 6)]
    found = outliers.outlier_cards(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r.LYLTY_CARD_NBR for r in found] == [900]
    assert found[0].median == 4


def test_a_card_far_below_is_found_too(spark):
    rows = [(c, 1000 + c % 7) for c in range(100)] + [(500, 1)]
    found = outliers.outlier_cards(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.LYLTY_CARD_NBR, r.deviations < 0) for r in found] == [(500, True)]


def test_nothing_to_judge(spark):
    for rows in ([], [(1, 3)], [(1, 3), (2, 3)], [(None, 900), (1, 3), (2, 4)], [(1, None), (2, None)]):
        assert outliers.outlier_cards(spark.createDataFrame(rows, SCHEMA)).count() == 0
    spoilt = spark.createDataFrame([(c, 2.0) for c in range(9)] + [(5, float("nan"))], "LYLTY_CARD_NBR bigint, PROD_QTY double")
    assert outliers.outlier_cards(spoilt).count() == 0
