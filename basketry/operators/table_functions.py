"""The similarity measures of a store as SQL table functions, called with a metric and a store.

    register(pre)                        # measures of the months before the trial
    SELECT * FROM store_correlation('totSales', 77)
    SELECT * FROM store_magnitude('nCustomers', 77) WHERE Store2 <> 77

The functions are SQL themselves: Spark puts their body in place of the call, so a constant store becomes
a filter on the scan of the measures. Several stores are several calls under UNION ALL. A LATERAL join with stores
of a table gives the same rows, but Spark then pairs all stores before it picks the asked ones; for
many stores take ``control.pair_similarity``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from basketry.operators.stores import METRICS

CORRELATION = "store_correlation"
MAGNITUDE = "store_magnitude"
SCORES = "control_candidates"


def _name(identifier: str) -> str:
    return "`" + identifier.replace("`", "``") + "`"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _values(view: str, metrics: Sequence[str]) -> str:
    """The asked metric of every store and month; an unknown metric is an error."""
    cases = " ".join(f"WHEN {_text(m)} THEN CAST({_name(m)} AS DOUBLE)" for m in metrics)
    known = _text("unknown metric, not one of: " + ", ".join(metrics))
    return f"""v AS (SELECT STORE_NBR, YEARMONTH, CASE metric {cases} ELSE raise_error({known}) END AS value FROM {_name(view)})"""


def register(
    measures: DataFrame,
    metrics: Sequence[str] = METRICS,
    view: str = "pre_trial_measures",
    correlation: str = CORRELATION,
    magnitude: str = MAGNITUDE,
    scores: str = SCORES,
) -> None:
    """Create the view and the three temporary functions in the session of ``measures``.

    ``correlation(metric, store)`` and ``magnitude(metric, store)`` give a row per candidate, the store
    itself included, with the values of ``control.store_correlation`` and ``control.store_magnitude``.
    ``scores(store, corr_weight)`` gives the mean over the metrics of the weighted two. A store that
    isn't among the measures, and a missing one, give no rows. Registering again replaces the view and the functions;
    queries made before keep theirs.
    """
    spark = measures.sparkSession
    measures.createOrReplaceTempView(_name(view))
    values = _values(view, metrics)
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION {_name(correlation)}(metric STRING, store BIGINT)
RETURNS TABLE (Store1 BIGINT, Store2 BIGINT, corr_measure DOUBLE) RETURN
WITH {values}
SELECT a.STORE_NBR, b.STORE_NBR,
       try_divide(covar_samp(a.value, b.value), stddev_samp(a.value) * stddev_samp(b.value))
FROM v a JOIN v b ON a.YEARMONTH = b.YEARMONTH
WHERE a.STORE_NBR = store
GROUP BY a.STORE_NBR, b.STORE_NBR"""
    )
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION {_name(magnitude)}(metric STRING, store BIGINT)
RETURNS TABLE (Store1 BIGINT, Store2 BIGINT, mag_measure DOUBLE) RETURN
WITH {values},
spread AS (SELECT YEARMONTH, min(value) AS least, max(value) AS most FROM v GROUP BY YEARMONTH),
own AS (
  SELECT v.STORE_NBR, v.YEARMONTH, v.value, greatest(most - v.value, v.value - least) AS far
  FROM v JOIN spread ON v.YEARMONTH = spread.YEARMONTH)
SELECT own.STORE_NBR, v.STORE_NBR, avg(1 - try_divide(abs(own.value - v.value), own.far))
FROM own JOIN v ON own.YEARMONTH = v.YEARMONTH
WHERE own.STORE_NBR = store
GROUP BY own.STORE_NBR, v.STORE_NBR"""
    )
    # All metrics side by side: a function called inside another one would not be folded into its plan.
    columns = [(_name(m), _name(f"low_{m}"), _name(f"high_{m}"), _name(f"far_{m}")) for m in metrics]
    ends = ", ".join(f"min({m}) AS {low}, max({m}) AS {high}" for m, low, high, _ in columns)
    own = ", ".join(f"p.{m}, greatest({high} - p.{m}, p.{m} - {low}) AS {far}" for m, low, high, far in columns)
    corr = " + ".join(
        f"try_divide(covar_samp(own.{m}, p.{m}), stddev_samp(own.{m}) * stddev_samp(p.{m}))" for m, *_ in columns
    )
    mag = " + ".join(f"avg(1 - try_divide(abs(own.{m} - p.{m}), own.{far}))" for m, _, _, far in columns)
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION {_name(scores)}(store BIGINT, corr_weight DOUBLE)
RETURNS TABLE (Store1 BIGINT, Store2 BIGINT, finalControlScore DOUBLE) RETURN
WITH spread AS (SELECT YEARMONTH, {ends} FROM {_name(view)} GROUP BY YEARMONTH),
own AS (
  SELECT p.STORE_NBR, p.YEARMONTH, {own}
  FROM {_name(view)} p JOIN spread ON p.YEARMONTH = spread.YEARMONTH
  WHERE p.STORE_NBR = store)
SELECT Store1, Store2, (corr_weight * corr + (1 - corr_weight) * mag) / {len(metrics)}
FROM (SELECT own.STORE_NBR AS Store1, p.STORE_NBR AS Store2, {corr} AS corr, {mag} AS mag
      FROM own JOIN {_name(view)} p ON own.YEARMONTH = p.YEARMONTH
      GROUP BY own.STORE_NBR, p.STORE_NBR)"""
    )
