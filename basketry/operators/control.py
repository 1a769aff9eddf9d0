"""Choice of a control store for every trial store, for all trials and metrics in one plan."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.stats import correlation
from basketry.functions.values import largest_first, smallest_first
from basketry.operators.stores import METRICS, TrialDesign

SALES, CUSTOMERS = METRICS

# The names of the scores.
SCORES = {SALES: "scoreNSales", CUSTOMERS: "scoreNCust"}


def trial_series(pre: DataFrame, trials: Sequence[int], metrics: Sequence[str]) -> DataFrame:
    """Monthly values of the trial stores, with the largest distance any store has to them.

    The largest of |own - other| over all stores follows from the month's minimum and
    maximum, so it needs no pairs. The smallest is 0: the trial store is its own candidate.
    """
    spread = pre.groupBy("YEARMONTH").agg(
        *[F.min(m).alias(f"{m}_min") for m in metrics],
        *[F.max(m).alias(f"{m}_max") for m in metrics],
    )
    own = pre.filter(F.col("STORE_NBR").isin(list(trials)))
    return own.join(spread, "YEARMONTH").select(
        F.col("STORE_NBR").alias("Store1"),
        "YEARMONTH",
        *[F.col(m).alias(f"{m}_1") for m in metrics],
        *[
            F.greatest(F.col(f"{m}_max") - F.col(m), F.col(m) - F.col(f"{m}_min")).alias(
                f"{m}_far"
            )
            for m in metrics
        ],
    )


def aligned_pairs(
    pre: DataFrame, trials: Sequence[int], metrics: Sequence[str] = METRICS
) -> DataFrame:
    """Trial and candidate values side by side per month: (Store1, Store2, YEARMONTH, ...).

    The trial side is one row per month with the listed trials in an array, so a candidate
    row meets one row whatever the number of trials, and adaptive execution chooses the join.
    Where the months of a store lie side by side, as in the staged measures, grouping the pairs
    merges them in the map tasks and moves one row per pair.
    """
    own = trial_series(pre, trials, metrics)
    fields = [c for c in own.columns if c != "YEARMONTH"]
    by_month = own.groupBy("YEARMONTH").agg(F.collect_list(F.struct(*fields)).alias("_trials"))
    candidates = pre.select(
        F.col("STORE_NBR").alias("Store2"),
        "YEARMONTH",
        *[F.col(m).alias(f"{m}_2") for m in metrics],
    )
    paired = candidates.join(by_month, "YEARMONTH").withColumn("_trial", F.explode("_trials"))
    return paired.select("_trial.*", *candidates.columns)


def _distance(metric: str) -> Column:
    return F.abs(F.col(f"{metric}_1") - F.col(f"{metric}_2"))


def _closeness(metric: str) -> Column:
    """1 for the nearest store of the month, 0 for the farthest; missing if all are equal."""
    return 1 - F.try_divide(_distance(metric), F.col(f"{metric}_far"))


def store_pairs(
    pre: DataFrame, trials: Sequence[int], metrics: Sequence[str] = METRICS
) -> DataFrame:
    """Long form of the aligned pairs: one row per trial, candidate, month and metric."""
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.col(f"{m}_1").cast("double").alias("v1"),
                F.col(f"{m}_2").cast("double").alias("v2"),
                _distance(m).cast("double").alias("distance"),
            )
            for m in metrics
        ]
    )
    pairs = aligned_pairs(pre, trials, metrics)
    return pairs.select("Store1", "Store2", "YEARMONTH", F.explode(rows).alias("r")).select(
        "Store1", "Store2", "YEARMONTH", "r.*"
    )


def pair_similarity(
    pre: DataFrame, trials: Sequence[int], metrics: Sequence[str] = METRICS
) -> DataFrame:
    """Correlation and mean closeness per (trial, candidate), one column per metric."""
    return (
        aligned_pairs(pre, trials, metrics)
        .groupBy("Store1", "Store2")
        .agg(
            *[correlation(F.col(f"{m}_1"), F.col(f"{m}_2")).alias(f"corr_{m}") for m in metrics],
            *[F.avg(_closeness(m)).alias(f"mag_{m}") for m in metrics],
        )
    )


def _by_metric(pairs: DataFrame, prefix: str, name: str, metrics: Sequence[str]) -> DataFrame:
    rows = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(f"{prefix}_{m}").alias(name))
            for m in metrics
        ]
    )
    return pairs.select("Store1", "Store2", F.explode(rows).alias("r")).select(
        "Store1", "Store2", "r.*"
    )


def store_correlation(
    pre: DataFrame, trials: Sequence[int], metrics: Sequence[str] = METRICS
) -> DataFrame:
    """Pearson correlation of every store with every trial store over the pre-trial months."""
    return _by_metric(pair_similarity(pre, trials, metrics), "corr", "corr_measure", metrics)


def store_magnitude(
    pre: DataFrame, trials: Sequence[int], metrics: Sequence[str] = METRICS
) -> DataFrame:
    """Mean monthly closeness in size, scaled to 0..1 over all candidates of a month."""
    return _by_metric(pair_similarity(pre, trials, metrics), "mag", "mag_measure", metrics)


def control_scores(
    pre: DataFrame,
    design: TrialDesign,
    mixed_magnitude: Collection[int] = (),
    metrics: Mapping[str, str] = SCORES,
) -> DataFrame:
    """Weighted score per metric and their mean.

    ``metrics`` names the score of each metric; their mean decides. For the trials in
    ``mixed_magnitude`` the sales score takes the customers' closeness, as the original run
    does for its second store.
    """
    w = design.corr_weight
    pairs = pair_similarity(pre, design.trials, list(metrics))

    def magnitude(metric: str) -> Column:
        own = F.col(f"mag_{metric}")
        if metric != SALES or not mixed_magnitude:
            return own
        mixed = F.col("Store1").isin(list(mixed_magnitude))
        return F.when(mixed, F.col(f"mag_{CUSTOMERS}")).otherwise(own)

    scores = [
        (F.col(f"corr_{metric}") * w + magnitude(metric) * (1 - w)).alias(name)
        for metric, name in metrics.items()
    ]
    share = 1 / len(metrics)
    mean = sum((F.col(name) * share for name in metrics.values()), F.lit(0.0))
    return pairs.select("Store1", "Store2", *scores).withColumn("finalControlScore", mean)


def control_store(scores: DataFrame) -> DataFrame:
    """Best-scored other store per trial store; equal scores go to the smaller store number.

    The limit on the row number is applied in every task before the shuffle, so only one
    candidate per trial and task is moved.
    """
    order = [largest_first("finalControlScore"), *smallest_first("Store2")]
    best = Window.partitionBy("Store1").orderBy(*order)
    return (
        scores.filter(F.col("Store1") != F.col("Store2"))
        .withColumn("place", F.row_number().over(best))
        .filter(F.col("place") == 1)
        .drop("place")
        .select("Store1", "Store2", "finalControlScore")
    )
