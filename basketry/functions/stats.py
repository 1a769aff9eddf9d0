"""Correlation that survives constant series, and the Student-t distribution."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

_HALF_LOG_PI = math.log(math.pi) / 2
_TERMS = 45  # of the continued fraction, two factors each: relative error 1e-10 for df up to 1e6
_TINY = 1e-300
_MOVES = 10  # Newton steps


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; NULL where a series is constant."""
    spread = F.stddev_samp(x) * F.stddev_samp(y)
    return F.try_divide(F.covar_samp(x, y), spread)


def _log_gamma(z: Column) -> Column:
    """log of the gamma function for z >= 0.5, by Stirling's series at z + 8."""
    shifted = z + 8
    product = z
    for k in range(1, 8):
        product = product * (z + k)
    inverse = 1 / shifted
    square = inverse * inverse
    series = inverse * (
        F.lit(1 / 12)
        + square * (F.lit(-1 / 360) + square * (F.lit(1 / 1260) + square * (F.lit(-1 / 1680) + square * F.lit(1 / 1188))))
    )
    half_log_two_pi = math.log(2 * math.pi) / 2
    return (shifted - 0.5) * F.log(shifted) - shifted + half_log_two_pi + series - F.log(product)


def _log_ratio(df: Column) -> Column:
    """log of gamma((df + 1) / 2) / gamma(df / 2); a series for large df, where the two nearly cancel."""
    x = df / 2
    small = _log_gamma(x + 0.5) - _log_gamma(F.greatest(x, F.lit(0.5)))
    i = 1 / x
    large = F.log(x) / 2 - i / 8 + i * i * i / 192 - i * i * i * i * i / 640 + F.pow(i, F.lit(7.0)) * (17 / 14336)
    return F.when(df > 40, large).otherwise(small)


def _let(use: Callable[[Column], Column], **values: Column) -> Column:
    """``use`` of a struct of values, each computed once however often it is used."""
    bound = F.struct(*[value.alias(name) for name, value in values.items()])
    return F.element_at(F.transform(F.array(bound), use), 1)


def _away(value: Column) -> Column:
    """Not quite zero."""
    return F.when(F.abs(value) < _TINY, F.lit(_TINY)).otherwise(value)


def _fraction(x: Column, a: Column, b: Column) -> Column:
    """The continued fraction of the incomplete beta function, by the modified Lentz scheme.

    Two factors a step; converges quickly for x < (a + 1) / (a + b + 2). The arguments are used in every step.
    """

    def turned(c: Column, d: Column, f: Column, by: Column, use: Callable[[Column], Column]) -> Column:
        """The state after one more factor."""
        return _let(
            lambda n: _let(use, c=n["c"], d=n["d"], f=n["f"] * n["c"] * n["d"]),
            c=_away(1 + by / c),
            d=1 / _away(1 + by * d),
            f=f,
        )

    def step(at: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return _let(
            lambda k: turned(at["c"], at["d"], at["f"], k["even"], lambda n: turned(n["c"], n["d"], n["f"], k["odd"], lambda s: s)),
            even=even,
            odd=odd,
        )

    start = 1 / _away(1 - (a + b) * x / (a + 1))
    first = F.struct(F.lit(1.0).alias("c"), start.alias("d"), start.alias("f"))
    steps = F.sequence(F.lit(1), F.lit(_TERMS)).cast("array<double>")
    return F.aggregate(steps, first, step, lambda at: at["f"])


def _upper(t: Column, df: Column, log_ratio: Column) -> Column:
    """P(T > t) for t >= 0: half the incomplete beta function of df / (df + t^2) at (df / 2, 1 / 2).

    Near the centre its complement is taken instead, where the fraction converges faster.
    """

    def of_square(v: Column) -> Column:
        square, n = v["square"], v["df"]
        x, rest, a, half = n / (n + square), square / (n + square), n / 2, F.lit(0.5)
        front = F.exp(-a * F.log1p(square / n) + F.log(rest) / 2 + v["log_ratio"] - _HALF_LOG_PI)
        outer = x < (a + 1) / (a + 2.5)
        return _let(
            of_part,
            front=front,
            outer=outer,
            u=F.when(outer, x).otherwise(rest),
            p=F.when(outer, a).otherwise(half),
            q=F.when(outer, half).otherwise(a),
            centre=square == 0,
        )

    def of_part(w: Column) -> Column:
        # I_x(a, b), or 1 - I_(1-x)(b, a): one fraction with chosen arguments.
        part = w["front"] * _fraction(w["u"], w["p"], w["q"]) / w["p"]
        tail = _let(lambda v: F.when(w["outer"], v["part"]).otherwise(1 - v["part"]) / 2, part=part)
        return F.when(w["centre"], 0.5).otherwise(tail)

    return _let(of_square, square=t * t, df=df, log_ratio=log_ratio)


def t_upper_tail(t: Column, df: Column) -> Column:
    """P(T > t) for Student's t with real-valued ``df`` >= 1, in constant work per row."""
    degrees = df.cast("double")
    tail = _upper(F.abs(t).cast("double"), degrees, _log_ratio(degrees))
    found = _let(lambda v: F.when(t >= 0, v["tail"]).otherwise(1 - v["tail"]), tail=tail)
    return F.when(t.isNotNull() & df.isNotNull(), found)


def t_quantile(p: float, df: Column) -> Column:
    """Quantile of Student's t for 0.5 <= p < 1 and ``df`` >= 1.

    Newton steps for the logarithm of the upper tail as a function of log t, in which a heavy tail is a
    straight line. They start at the normal quantile, which lies at or below, and pass the quantile at most
    once, since the tail falls ever steeper; t stays positive.
    """
    if not 0.5 <= p < 1:
        raise ValueError("p must lie in [0.5, 1)")
    if p == 0.5:
        return F.when(df.isNotNull(), 0.0)
    wanted = 1 - p

    def search(v: Column) -> Column:
        n, ratio = v["df"], v["log_ratio"]

        def move(t: Column, _i: Column) -> Column:
            log_density = ratio - _HALF_LOG_PI - F.log(n) / 2 - (n + 1) / 2 * F.log1p(t * t / n)
            return _let(
                lambda w: t * F.exp(F.log(w["tail"] / wanted) * w["tail"] / (t * w["density"])),
                tail=_upper(t, n, ratio),
                density=F.exp(log_density),
            )

        return F.aggregate(F.sequence(F.lit(1), F.lit(_MOVES)), F.lit(NormalDist().inv_cdf(p)), move)

    degrees = df.cast("double")
    return F.when(df.isNotNull(), _let(search, df=degrees, log_ratio=_log_ratio(degrees)))
