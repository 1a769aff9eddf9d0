"""Column expressions: missing values, text rules, dates and the t distribution."""

import datetime as dt

import math

import pytest
from pyspark.sql import functions as F

from basketry.functions import dates, stats, text, values


def column(df, expr):
    return [r[0] for r in df.select(expr.alias("v")).collect()]


@pytest.fixture(scope="module")
def names(spark):
    def make(*rows):
        return spark.createDataFrame([(r,) for r in rows], "x string")

    return make


def test_exclusion_keeps_missing_names(names):
    df = names("Salsa a", None, "Chips", "salsa small")
    kept = df.filter(text.lacks(F.col("x"), "Salsa"))
    assert sorted(r.x or "" for r in kept.collect()) == ["", "Chips", "salsa small"]


def test_two_way_label_keeps_missing(names):
    df = names("Mainstream", None, "Budget")
    got = column(df, values.two_way(F.col("x"), "Mainstream", "Non-Mainstream"))
    assert got == ["Mainstream", None, "Non-Mainstream"]


def test_distinct_count_counts_missing_once(spark):
    df = spark.createDataFrame([(1,), (2,), (None,), (None,)], "x int")
    assert df.agg(values.n_unique("x")).first()[0] == 3
    assert df.filter("x is not null").agg(values.n_unique("x")).first()[0] == 2


def test_largest_first_puts_missing_last(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "x int")
    assert [r.x for r in df.orderBy(values.largest_first("x")).collect()] == [2, 1, None]


def test_missing_covers_nan_in_doubles_only(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (None, None)], "x double, y string")
    assert column(df, values.is_missing(df, "x")) == [False, True, True]
    assert column(df, values.is_missing(df, "y")) == [False, False, True]


def test_letters_and_digits(names):
    df = names("Twist", "&", "hot", "175g", "٣", "été", "")
    kept = df.filter(~text.has_digit(F.col("x")) & text.has_letter(F.col("x")))
    assert [r.x for r in kept.collect()] == ["Twist", "hot", "été"]


@pytest.mark.parametrize(
    "name, number",
    [
        ("A 1,250g", 1250.0),
        ("C 2.5kg", 2.5),
        ("D - 40g", 40.0),
        ("none", None),
        ("Natural Chip Co 175g", 175.0),
        ("Kettle 135g Swt Pot", 135.0),
        ("Chs&Onion170g", 170.0),
        (None, None),
    ],
)
def test_first_number(names, name, number):
    assert column(names(name, "pad 1"), text.first_number(F.col("x")))[0] == number


def test_first_word(names):
    df = names("Natural Chip Co 175g", "one", " leading", None)
    got = column(df, text.first_word_upper(F.col("x")))
    assert got == ["NATURAL", "ONE", "", None]


def test_serial_and_month(spark):
    one = spark.range(1)
    day = dates.serial_to_date(F.lit(43390))
    assert column(one, day) == [dt.date(2018, 10, 17)]
    assert column(one, dates.date_to_serial(day)) == [43390]
    assert column(one, dates.yearmonth(day)) == [201810]
    assert column(one, dates.month_start(F.lit(201902))) == [dt.date(2019, 2, 1)]
    assert column(one, dates.month_start(F.lit(201812))) == [dt.date(2018, 12, 1)]


@pytest.mark.parametrize(
    "share, label", [(0.1234, "12.3 %"), (0.12, "12 %"), (0.057, "5.7 %"), (1.0, "100 %")]
)
def test_percent_label(spark, share, label):
    assert column(spark.range(1), values.percent_label(F.lit(share))) == [label]


def test_correlation_of_constant_is_missing(spark):
    df = spark.createDataFrame(
        [("c", 1.0, 2.0), ("c", 1.0, 3.0), ("c", 1.0, 4.0), ("l", 1.0, 2.0), ("l", 2.0, 4.0), ("l", 4.0, 8.0), ("s", 1.0, 1.0)],
        "k string, x double, y double",
    )
    got = dict(
        df.groupBy("k").agg(stats.correlation(F.col("x"), F.col("y")).alias("r")).collect()
    )
    assert got["c"] is None and got["s"] is None
    assert got["l"] == pytest.approx(1.0)


@pytest.mark.parametrize(
    "t, df, tail",
    [
        (1.894578605, 7.0, 0.05),
        (2.0, 1165.0, 0.022866),
        (-2.0, 1165.0, 1 - 0.022866),
        (0.0, 5.0, 0.5),
        (40.0, 1.0, 0.0079561),
        (2.0, 1e11, 0.0227501),
        (500.0, 1e6, 0.0),
    ],
)
def test_upper_tail(spark, t, df, tail):
    got = column(spark.range(1), stats.t_upper_tail(F.lit(t), F.lit(df)))[0]
    assert got == pytest.approx(tail, abs=1e-6)


@pytest.mark.parametrize(
    "p, df, q",
    [
        (0.95, 7.0, 1.894579),
        (0.95, 6.0, 1.943180),
        (0.95, 1.0, 6.313752),
        (0.95, 237.3468, 1.651299),
        (0.975, 2.0, 4.302653),
        (0.9999, 1e6, 3.719030),
        (0.95, 1e11, 1.644854),
        (0.5, 4.0, 0.0),
    ],
)
def test_quantile(spark, p, df, q):
    assert column(spark.range(1), stats.t_quantile(p, F.lit(df)))[0] == pytest.approx(q, abs=1e-6)


def test_quantile_of_missing_df(spark):
    assert column(spark.range(1), stats.t_quantile(0.95, F.lit(None).cast("double"))) == [None]


@pytest.mark.parametrize(
    ("p", "df", "q"), [(1 - 1e-8, 7.0, 27.8023), (1 - 1e-10, 7.0, 53.836), (1 - 1e-8, 1000.0, 5.65791), (0.5, 3.0, 0.0)]
)
def test_quantile_far_in_the_tail(spark, p, df, q):
    got = spark.range(1).select(stats.t_quantile(p, F.lit(df))).first()[0]
    assert got == pytest.approx(q, rel=2e-5, abs=1e-9)


def _by_integration(t, df, n=40_000):
    """The upper tail by Simpson's rule over theta, with t = sqrt(df) * tan(theta)."""
    far = min(math.pi / 2 - 1e-12, 60 / math.sqrt(df)) if df > 50 else math.pi / 2 - 1e-12
    near = math.atan(t / math.sqrt(df))
    step = (far - near) / n

    def density(theta):
        return math.exp(-(df - 1) / 2 * math.log1p(math.tan(theta) ** 2))

    total = density(near) + density(far) + 4 * sum(density(near + (2 * i + 1) * step) for i in range(n // 2))
    total += 2 * sum(density(near + 2 * i * step) for i in range(1, n // 2))
    a = df / 2
    ratio = math.lgamma(a + 0.5) - math.lgamma(a) if df < 1e3 else math.log(a) / 2 - 1 / (8 * a) + 1 / (192 * a**3)
    return total * step / 3 * math.exp(ratio) / math.sqrt(math.pi)


def test_tail_and_quantile_are_precise_for_every_row(spark):
    """Both take a column of degrees of freedom; 1e-10 from 1 to a million."""
    points = [(t, df) for df in (1.0, 2.0, 3.5, 7.0, 39.9, 40.1, 72.0, 1000.0, 1e4, 1e6) for t in (0.05, 0.7, 1.5, 2.5, 4.0)]
    df = spark.createDataFrame(points, "t double, df double").repartition(2)
    quantile = stats.t_quantile(0.975, F.col("df"))
    got = df.select("t", "df", stats.t_upper_tail(F.col("t"), F.col("df")).alias("tail"), quantile.alias("q")).collect()
    for r in got:
        assert r.tail == pytest.approx(_by_integration(r.t, r.df), rel=2e-10), (r.t, r.df)
        assert _by_integration(r.q, r.df) == pytest.approx(0.025, rel=2e-9)
    both = spark.range(1).select(stats.t_upper_tail(F.lit(-1.5), F.lit(7.0)) + stats.t_upper_tail(F.lit(1.5), F.lit(7.0)))
    assert both.first()[0] == pytest.approx(1, abs=1e-15)
    assert spark.range(1).select(stats.t_upper_tail(F.lit(None).cast("double"), F.lit(7.0))).first()[0] is None


def test_order_puts_missing_and_nan_last(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan")), (3, 0.5), (4, 2.0)], "k int, x double")
    down = [r.k for r in df.orderBy(values.largest_first("x"), "k").collect()]
    up = [r.k for r in df.orderBy(*values.smallest_first("x")).collect()]
    assert down == [4, 3, 1, 2] and up == [3, 4, 2, 1]
