"""Cards that buy far more or less than others, found by their distance from the median."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators import quantiles
from basketry.operators.segments import CARD
from basketry.session import stage

#: How many deviations from the median count as an outlier.
LIMIT = 10.0

# For normally distributed values, the standard deviation over the median absolute
# deviation, and over the mean absolute deviation.
_OF_MEDIAN = 1.482602218505602
_OF_MEAN = 1.2533141373155001


def _median(base: DataFrame, column: str) -> float | None:
    found = quantiles.quartiles(base, quantiles.sketch_state(base, [column]), [column])[1]
    return found[column][1]


def centre_and_spread(base: DataFrame, column: str) -> tuple[float | None, float | None]:
    """Exact median of natural values and their spread around it, on the scale of a standard deviation.

    The spread comes from the median absolute deviation; where more than half of the values are equal, so that it is 0,
    from the mean absolute deviation. Both are missing without values. Selection is distributed: the
    driver gets sketches, counts and at most some thousand values (``quantiles.quartiles``).
    """
    centre = _median(base, column)
    if centre is None:
        return None, None
    away = base.select(F.abs(F.col(column).cast("double") - F.lit(centre)).alias("away"))
    spread = _median(away, "away")
    if spread:
        return centre, spread * _OF_MEDIAN
    return centre, away.agg(F.avg("away")).first()[0] * _OF_MEAN


def outlier_cards(txns: DataFrame, limit: float = LIMIT) -> DataFrame:
    """Cards whose units lie more than ``limit`` deviations from the median card, farthest first.

    The lines are added up per card first: the usual line has the same few units, so the spread of single
    lines says little, while a card that buys far too much stands out by its sum. Rows without a card
    aren't judged, missing and NaN quantities count nothing; where all cards are equal none is proposed. The
    passes run when this is called.
    """
    known = F.when(~F.isnan(F.col("PROD_QTY").cast("double")), F.col("PROD_QTY"))
    totals = stage(
        txns.filter(F.col(CARD).isNotNull())
        .groupBy(CARD)
        .agg(F.count(F.lit(1)).alias("n_lines"), F.sum(known).alias("units"), F.max(known).alias("largest"))
    )
    centre, spread = centre_and_spread(quantiles.naturals(totals, ["units"]), "units")
    middle, wide = (F.lit(x).cast("double") for x in (centre, spread))
    judged = totals.select(
        CARD,
        "n_lines",
        F.col("units").cast("double").alias("units"),
        F.col("largest").cast("double").alias("largest"),
        middle.alias("median"),
        F.try_divide(F.col("units").cast("double") - middle, wide).alias("deviations"),
    )
    far = judged.filter(F.abs("deviations") > limit)
    return far.orderBy(F.abs("deviations").desc(), CARD)
