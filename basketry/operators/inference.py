"""Welch's two-sample t-test from one aggregation pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.stats import t_quantile, t_upper_tail
from basketry.functions.values import known_number


def welch_greater(
    df: DataFrame, value: str, first: Column, second: Column, level: float = 0.95
) -> DataFrame:
    """One row: is the mean of ``value`` greater where ``first`` holds than where ``second`` does?

    Missing values and NaN are left out. Variances may differ. ``ci_low`` is the lower bound of the
    one-sided interval for the difference of the means.
    """
    x = F.when(first, known_number(value))
    y = F.when(second, known_number(value))
    moments = df.filter(first | second).agg(
        F.avg(x).alias("mean_x"),
        F.avg(y).alias("mean_y"),
        F.var_samp(x).alias("var_x"),
        F.var_samp(y).alias("var_y"),
        F.count(x).alias("n_x"),
        F.count(y).alias("n_y"),
    )
    return _tested(moments, level)


def value_moments(df: DataFrame, value: str, by: str) -> DataFrame:
    """Number, mean and variance of the values per ``by``; missing values and NaN are left out.

    One row per card in place of its lines: a heavy card is one row in the join to the customers.
    """
    x = known_number(value)
    return df.groupBy(by).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("variance")
    )


def welch_of_moments(
    moments: DataFrame, first: Column, second: Column, level: float = 0.95
) -> DataFrame:
    """The test of ``welch_greater`` from the ``value_moments`` of parts.

    The means are taken from a centre, the mean of all chosen values, so that squares of large means
    don't hide a small variance.
    """
    chosen = moments.filter((first | second) & (F.col("n") > 0))
    centre = chosen.agg(F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n"))).scalar()
    centred = chosen.withColumn("_centre", centre).withColumn("_off", F.col("mean") - F.col("_centre"))
    sums = []
    for name, side in (("x", first), ("y", second)):
        n, off = F.when(side, F.col("n")), F.col("_off")
        sums += [
            F.coalesce(F.sum(n), F.lit(0)).alias(f"n_{name}"),
            F.sum(n * off).alias(f"off_{name}"),
            F.sum(n * (F.col("variance") + off * off)).alias(f"square_{name}"),
        ]
    merged = centred.agg(F.first("_centre").alias("_centre"), *sums)
    for name in ("x", "y"):
        n, off = F.col(f"n_{name}"), F.col(f"off_{name}")
        merged = merged.withColumns(
            {
                f"mean_{name}": F.col("_centre") + F.try_divide(off, n),
                f"var_{name}": F.try_divide(
                    F.greatest(F.col(f"square_{name}") - F.try_divide(off * off, n), F.lit(0.0)), n - 1
                ),
            }
        )
    return _tested(merged, level)


def _tested(moments: DataFrame, level: float) -> DataFrame:
    vx = F.try_divide("var_x", "n_x")
    vy = F.try_divide("var_y", "n_y")
    parts = moments.withColumns({"vx": vx, "vy": vy})
    se = F.sqrt(F.col("vx") + F.col("vy"))
    spread = F.try_divide(F.col("vx") * F.col("vx"), F.col("n_x") - 1) + F.try_divide(
        F.col("vy") * F.col("vy"), F.col("n_y") - 1
    )
    tested = parts.withColumn("se", se).withColumns(
        {
            "t": F.try_divide(F.col("mean_x") - F.col("mean_y"), F.col("se")),
            "df": F.try_divide(F.col("se") * F.col("se") * F.col("se") * F.col("se"), spread),
        }
    )
    return tested.select(
        "mean_x",
        "mean_y",
        "n_x",
        "n_y",
        "t",
        "df",
        t_upper_tail(F.col("t"), F.col("df")).alias("p_value"),
        (F.col("mean_x") - F.col("mean_y") - t_quantile(level, F.col("df")) * F.col("se")).alias(
            "ci_low"
        ),
    )
