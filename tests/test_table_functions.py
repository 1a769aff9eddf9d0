"""The similarity measures as SQL table functions equal the DataFrame forms."""

import pytest

from basketry.operators import control, table_functions
from basketry.operators.stores import METRICS, TrialDesign


@pytest.fixture(scope="module")
def measures(spark):
    """Nine stores over seven months; store 9 never changes, store 8 lacks a month."""
    rows = [
        (s, 201900 + m, float((s * m * 7) % 11 + s), (s * 5 + m * m) % 13 if s < 9 else 4)
        for s in range(1, 10)
        for m in range(1, 8)
        if not (s == 8 and m == 3)
    ]
    rows = [(s, m, 5.0 if s == 9 else x, c) for s, m, x, c in rows]
    return spark.createDataFrame(rows, "STORE_NBR bigint, YEARMONTH int, totSales double, nCustomers bigint")


def near(rows):
    return sorted(
        (tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows),
        key=lambda r: r[:3] if isinstance(r[2], str) else r[:2],
    )


@pytest.mark.parametrize("metric", METRICS)
def test_measures_equal_the_dataframe_form(spark, measures, metric):
    table_functions.register(measures)
    for store in (1, 8, 9):
        for call, form, name in (
            ("store_correlation", control.store_correlation, "corr_measure"),
            ("store_magnitude", control.store_magnitude, "mag_measure"),
        ):
            got = spark.sql(f"SELECT Store1, Store2, {name} FROM {call}('{metric}', {store})").collect()
            want = form(measures, [store], [metric]).select("Store1", "Store2", name).collect()
            assert near(got) == near(want) and len(got) == 9


def test_scores_equal_the_dataframe_form(spark, measures):
    table_functions.register(measures)
    for store, weight in ((2, 0.5), (8, 0.25), (9, 0.5)):
        got = spark.sql(f"SELECT * FROM control_candidates({store}, {weight}D)").collect()
        design = TrialDesign(trials=(store,), corr_weight=weight)
        want = control.control_scores(measures, design).select("Store1", "Store2", "finalControlScore").collect()
        assert near(got) == near(want)


def test_functions_inside_a_query(spark, measures):
    """Joined to another table, filtered and aggregated; several stores by UNION ALL."""
    table_functions.register(measures)
    found = spark.sql(
        """WITH c AS (SELECT * FROM store_correlation('totSales', 1) UNION ALL SELECT * FROM store_correlation('totSales', 2)),
             m AS (SELECT * FROM store_magnitude('totSales', 1) UNION ALL SELECT * FROM store_magnitude('totSales', 2))
           SELECT c.Store1, max_by(c.Store2, corr_measure + mag_measure) AS best
           FROM c JOIN m ON c.Store1 = m.Store1 AND c.Store2 = m.Store2 WHERE c.Store1 <> c.Store2 GROUP BY c.Store1"""
    ).collect()
    pairs = control.pair_similarity(measures, [1, 2], ["totSales"]).where("Store1 <> Store2").collect()
    score = {(p.Store1, p.Store2): p.corr_totSales + p.mag_totSales for p in pairs if p.corr_totSales is not None}
    best = {t: max((v, k[1]) for k, v in score.items() if k[0] == t)[1] for t in (1, 2)}
    assert {r.Store1: r.best for r in found} == best


def test_lateral_join_gives_the_same_rows(spark, measures):
    table_functions.register(measures)
    asked = spark.sql(
        """SELECT f.* FROM VALUES ('totSales', 3L), ('totSales', 4L) AS t(metric, store),
           LATERAL store_correlation(t.metric, t.store) AS f"""
    ).collect()
    want = control.store_correlation(measures, [3, 4], ["totSales"]).select("Store1", "Store2", "corr_measure").collect()
    assert near(asked) == near(want)


def test_unknown_stores_and_metrics(spark, measures):
    table_functions.register(measures)
    assert spark.sql("SELECT * FROM store_correlation('totSales', 77)").count() == 0
    assert spark.sql("SELECT * FROM store_magnitude('totSales', CAST(NULL AS BIGINT))").count() == 0
    with pytest.raises(Exception, match="unknown metric"):
        spark.sql("SELECT * FROM store_correlation('nothing', 1)").collect()
    table_functions.register(measures.limit(0))
    assert spark.sql("SELECT * FROM control_candidates(1, 0.5D)").count() == 0


def test_names_are_quoted(spark, measures):
    odd = measures.withColumnRenamed("totSales", "it's `odd`")
    table_functions.register(odd, ["it's `odd`"], "odd view", "odd corr", "odd mag", "odd scores")
    got = spark.sql("SELECT * FROM `odd corr`('it\\'s `odd`', 1)").collect()
    want = control.store_correlation(measures, [1], ["totSales"]).select("Store1", "Store2", "corr_measure").collect()
    assert near(got) == near(want)


def test_a_constant_store_is_filtered_at_the_scan(spark, measures, tmp_path):
    measures.write.parquet(str(tmp_path / "m"))
    table_functions.register(spark.read.parquet(str(tmp_path / "m")))
    for call in ("store_correlation('totSales', 2)", "store_magnitude('totSales', 2)", "control_candidates(2, 0.5D)"):
        plan = spark.sql(f"SELECT * FROM {call}")._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(STORE_NBR,2)" in plan
        assert not [n for n in ("NestedLoop", "Cartesian", "EvalPython") if n in plan]
