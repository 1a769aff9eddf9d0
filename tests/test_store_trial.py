"""Control choice and trial assessment against a plain re-computation on small tables."""

import dataclasses
import datetime as dt
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from basketry.functions.dates import month_start
from basketry.operators import control, stores, uplift
from basketry.operators.inference import welch_greater
from basketry.operators.cleaning import with_price
from basketry.operators.segments import enrich
from basketry.session import stage
from basketry.sources import tpch

MONTHS = [201807 + i if i < 6 else 201901 + i - 6 for i in range(12)]
DESIGN = stores.TrialDesign()
SALES, CUSTOMERS = stores.METRICS


def make_measures(seed=11):
    """Twelve months of 15 stores; store 50 misses a month, store 60 is constant."""
    rng = random.Random(seed)
    rows = {}
    for store in (77, 86, 88, 1, 2, 3, 4, 5, 6, 7, 8, 9, 50, 60):
        level, people = rng.uniform(500, 1500), rng.randint(40, 120)
        for month in MONTHS:
            if store == 50 and month == 201812:
                continue
            sales = 800.0 if store == 60 else round(level * rng.uniform(0.8, 1.2), 2)
            rows[store, month] = (sales, 80 if store == 60 else people + rng.randint(-10, 10))
    return rows


@pytest.fixture(scope="module")
def world(spark):
    rows = make_measures()
    df = spark.createDataFrame(
        [(s, m, *v) for (s, m), v in rows.items()],
        "STORE_NBR bigint, YEARMONTH int, totSales double, nCustomers bigint",
    )
    return rows, df


def eligible_before(df):
    return stores.pre_trial_measures(stores.with_observed_months(df, DESIGN), DESIGN)


def pearson(x, y):
    mx, my = statistics.fmean(x), statistics.fmean(y)
    sxy = sum((a - mx) * (b - my) for a, b in zip(x, y))
    sxx, syy = sum((a - mx) ** 2 for a in x), sum((b - my) ** 2 for b in y)
    return None if sxx == 0 or syy == 0 else sxy / (sxx * syy) ** 0.5


def brute_scores(rows, trial, mixed=False):
    """corr, mag per metric and the final score of every eligible store."""
    eligible = [s for s in {k[0] for k in rows} if sum(k[0] == s for k in rows) == 12]
    pre = [m for m in MONTHS if m < DESIGN.pre_end]
    corr, mag = {}, {}
    for i in (0, 1):
        own = [rows[trial, m][i] for m in pre]
        dist = {s: [abs(o - rows[s, m][i]) for o, m in zip(own, pre)] for s in eligible}
        for s in eligible:
            corr[s, i] = pearson(own, [rows[s, m][i] for m in pre])
            parts = []
            for j in range(len(pre)):
                column = [dist[e][j] for e in eligible]
                parts.append(1 - (dist[s][j] - min(column)) / (max(column) - min(column)))
            mag[s, i] = statistics.fmean(parts)
    final = {}
    for s in eligible:
        if corr[s, 0] is None:
            continue
        size = mag[s, 1] if mixed else mag[s, 0]
        final[s] = 0.5 * (0.5 * corr[s, 0] + 0.5 * size) + 0.5 * (0.5 * corr[s, 1] + 0.5 * mag[s, 1])
    return corr, mag, final


def brute_control(rows, trial, mixed=False):
    final = brute_scores(rows, trial, mixed)[2]
    return sorted(((-v, s) for s, v in final.items() if s != trial))[0][1]


def brute_assess(rows, trial, ctl, i, compare=None, all_months=False):
    pre = [m for m in MONTHS if m < DESIGN.pre_end]
    factor = sum(rows[trial, m][i] for m in pre) / sum(rows[ctl, m][i] for m in pre)
    pct = {}
    for m in MONTHS:
        scaled = rows[ctl, m][i] * factor
        pct[m] = abs(scaled - rows[compare or trial, m][i]) / scaled
    sd = statistics.stdev([pct[m] for m in (MONTHS if all_months else pre)])
    return factor, pct, sd


def test_measures(spark):
    rows = []
    rng = random.Random(5)
    for i in range(900):
        store = 1 if i % 3 == 0 else rng.randint(1, 4)
        card = rng.choice([None, *range(1, 20)])
        rows.append((dt.date(2018, rng.randint(7, 9), rng.randint(1, 28)), store, card, rng.randint(1, 60), float(rng.randint(1, 4)), float(rng.randint(1, 900)) / 100))
    df = spark.createDataFrame(rows, "DATE date, STORE_NBR bigint, LYLTY_CARD_NBR bigint, TXN_ID bigint, PROD_QTY double, TOT_SALES double")
    got = {(r.STORE_NBR, r.YEARMONTH): r for r in stores.store_month_measures(df).collect()}
    few = {(r.STORE_NBR, r.YEARMONTH): r for r in stores.sales_and_customers(df).collect()}
    keys = {(r[1], r[0].year * 100 + r[0].month) for r in rows}
    assert set(got) == set(few) == keys
    for s, m in keys:
        mine = [r for r in rows if (r[1], r[0].year * 100 + r[0].month) == (s, m)]
        sales, cards, txns, units = sum(r[5] for r in mine), len({r[2] for r in mine}), len({r[3] for r in mine}), sum(r[4] for r in mine)
        r = got[s, m]
        assert r.totSales == pytest.approx(sales) and r.nCustomers == cards
        assert r.nTxnPerCust == pytest.approx(txns / cards)
        assert r.nChipsPerTxn == pytest.approx(units / txns)
        assert r.avgPricePerUnit == pytest.approx(sales / units)
        assert few[s, m].totSales == pytest.approx(sales) and few[s, m].nCustomers == cards


def test_eligibility(world):
    rows, df = world
    full = {r.STORE_NBR for r in stores.full_observation_stores(df, DESIGN).collect()}
    assert full == {k[0] for k in rows} - {50}
    pre = eligible_before(df)
    assert {r.STORE_NBR for r in pre.collect()} == full
    assert pre.agg(F.max("YEARMONTH")).first()[0] == 201901
    partial = dataclasses.replace(DESIGN, observed_until=201906, n_months=11)
    assert stores.full_observation_stores(df, partial).count() == len(full)


@pytest.mark.parametrize("trial", DESIGN.trials)
def test_similarity(world, trial):
    rows, df = world
    pre = eligible_before(df)
    corr, mag, final = brute_scores(rows, trial)
    index = {SALES: 0, CUSTOMERS: 1}
    for r in control.store_correlation(pre, [trial]).collect():
        want = corr[r.Store2, index[r.metric]]
        assert r.corr_measure == (None if want is None else pytest.approx(want))
        if r.Store2 == trial:
            assert r.corr_measure == pytest.approx(1)
    for r in control.store_magnitude(pre, [trial]).collect():
        assert r.mag_measure == pytest.approx(mag[r.Store2, index[r.metric]])
        if r.Store2 == trial:
            assert r.mag_measure == 1
    scores = {r.Store2: r.finalControlScore for r in control.control_scores(pre, dataclasses.replace(DESIGN, trials=[trial])).collect()}
    assert scores.pop(60) is None
    assert scores == {s: pytest.approx(v) for s, v in final.items()}


def test_control_store(world):
    rows, df = world
    pre = eligible_before(df)
    got = {r.Store1: r.Store2 for r in control.control_store(control.control_scores(pre, DESIGN)).collect()}
    assert got == {t: brute_control(rows, t) for t in DESIGN.trials}
    mixed = control.control_store(control.control_scores(pre, DESIGN, [86])).collect()
    assert {r.Store1: r.Store2 for r in mixed} == {t: brute_control(rows, t, mixed=t == 86) for t in DESIGN.trials}


def test_equal_scores_go_to_the_smaller_store(spark):
    scores = spark.createDataFrame(
        [(1, 1, 1.0), (1, 9, 0.5), (1, 4, 0.5), (1, 2, None), (2, 3, None)],
        "Store1 bigint, Store2 bigint, finalControlScore double",
    )
    got = sorted((r.Store1, r.Store2) for r in control.control_store(scores).collect())
    assert got == [(1, 4), (2, 3)]


def test_equal_distances_give_missing_closeness(spark):
    rows = [(s, m, 5.0, 7) for s in (77, 1) for m in MONTHS]
    df = spark.createDataFrame(rows, "STORE_NBR bigint, YEARMONTH int, totSales double, nCustomers bigint")
    pre = eligible_before(df)
    assert {r.mag_measure for r in control.store_magnitude(pre, [77]).collect()} == {None}


def test_ineligible_trial_gives_no_rows(world):
    _, df = world
    pre = eligible_before(df)
    assert control.store_pairs(pre, [50, 4711]).count() == 0


def test_pairs_are_aligned_by_month(world):
    rows, df = world
    pre = eligible_before(df)
    got = control.store_pairs(pre, [77, 86]).collect()
    assert len(got) == 2 * 13 * 7 * 2
    for r in got:
        i = 0 if r.metric == SALES else 1
        assert (r.v1, r.v2) == (rows[r.Store1, r.YEARMONTH][i], rows[r.Store2, r.YEARMONTH][i])
        assert r.distance == pytest.approx(abs(r.v1 - r.v2))


@pytest.fixture(scope="module")
def chosen(spark, world):
    rows, _ = world
    pairs = [(t, brute_control(rows, t)) for t in DESIGN.trials]
    return dict(pairs), spark.createDataFrame(pairs, "trial bigint, control bigint")


def test_labels_and_trend(world, chosen):
    rows, df = world
    pairs, table = chosen
    labels = uplift.store_type_labels(df, table).collect()
    assert len(labels) == len(rows) * 3
    for r in labels:
        want = "Trial" if r.STORE_NBR == r.trial else "Control" if r.STORE_NBR == pairs[r.trial] else "Other stores"
        assert r.Store_type == want
    for r in uplift.store_type_trend(df, table, DESIGN).collect():
        assert r.YEARMONTH < DESIGN.trend_end and r.TransactionMonth == dt.date(r.YEARMONTH // 100, r.YEARMONTH % 100, 1)
        if r.Store_type == "Other stores":
            others = [v for (s, m), v in rows.items() if m == r.YEARMONTH and s not in (r.trial, pairs[r.trial])]
            assert r.totSales == pytest.approx(statistics.fmean(v[0] for v in others))
            assert r.nCustomers == pytest.approx(statistics.fmean(v[1] for v in others))
        else:
            store = r.trial if r.Store_type == "Trial" else pairs[r.trial]
            assert (r.totSales, r.nCustomers) == rows[store, r.YEARMONTH]


@pytest.mark.parametrize("quirks", [False, True])
def test_assessment(world, chosen, quirks):
    rows, df = world
    pairs, table = chosen
    compare = {(86, CUSTOMERS): 77} if quirks else {}
    all_months = [(86, SALES)] if quirks else []
    series = uplift.paired_series(df, table, compare_with=compare)
    assessed = uplift.assess(series, DESIGN, all_months).collect()
    assert len(assessed) == 3 * 2 * 12
    for r in assessed:
        i = 0 if r.metric == SALES else 1
        factor, pct, sd = brute_assess(
            rows, r.trial, pairs[r.trial], i, compare.get((r.trial, r.metric)), (r.trial, r.metric) in all_months
        )
        raw = rows[pairs[r.trial], r.YEARMONTH][i]
        assert r.trial_value == rows[r.trial, r.YEARMONTH][i] and r.raw == raw
        assert r.factor == pytest.approx(factor) and r.scaled == pytest.approx(raw * factor)
        assert r.pct_diff == pytest.approx(pct[r.YEARMONTH]) and r.sd_pre == pytest.approx(sd)
        assert r.tValue == pytest.approx(pct[r.YEARMONTH] / sd)
        assert r.upper == pytest.approx(raw * (1 + 2 * sd)) and r.lower == pytest.approx(raw * (1 - 2 * sd))


def test_assessment_tables(world, chosen):
    rows, df = world
    pairs, table = chosen
    series = uplift.paired_series(df, table)
    assessed = uplift.assess(series, DESIGN)
    assert uplift.scaling_factors(assessed).count() == 6
    before = uplift.scaled_control(assessed).filter(DESIGN.in_pre()).groupBy("trial", "metric").agg(F.sum("scaled").alias("s"))
    for r in before.collect():
        i = 0 if r.metric == SALES else 1
        assert r.s == pytest.approx(sum(rows[r.trial, m][i] for m in MONTHS if m < DESIGN.pre_end))
    bands = uplift.trial_bands(assessed)
    assert bands.count() == 3 * 2 * 12 * 4
    assert {r.series for r in bands.select("series").distinct().collect()} == {"Trial", "Control", "Control upper", "Control lower"}
    bounds = uplift.trial_window_bounds(assessed, DESIGN).first()
    assert (bounds.first_month, bounds.last_month) == (dt.date(2019, 2, 1), dt.date(2019, 4, 1))
    tested = uplift.trial_t_values(assessed, DESIGN).collect()
    assert len(tested) == 18
    assert all(round(r.t_crit, 2) == 1.89 and r.significant == (r.tValue > r.t_crit) for r in tested)
    for r in uplift.trial_verdict(assessed, DESIGN).collect():
        i = 0 if r.metric == SALES else 1
        _, pct, sd = brute_assess(rows, r.trial, pairs[r.trial], i)
        trial_months = [m for m in MONTHS if DESIGN.trial_start <= m <= DESIGN.trial_end]
        outside = sum(
            abs(rows[r.trial, m][i] - rows[pairs[r.trial], m][i]) > 2 * sd * rows[pairs[r.trial], m][i] for m in trial_months
        )
        assert (r.months_outside, r.months_total) == (outside, 3)
        assert r.significant_months == sum(pct[m] / sd > 1.894579 for m in trial_months)


def test_band_on_scaled_control(world, chosen):
    _, df = world
    assessed = uplift.assess(uplift.paired_series(df, chosen[1]), DESIGN, band_on="scaled")
    for r in assessed.collect():
        assert (r.upper + r.lower) / 2 == pytest.approx(r.scaled)
    with pytest.raises(ValueError):
        uplift.assess(df, DESIGN, band_on="other")


def test_months_missing_on_one_side(spark):
    rows = [(77, m, 100.0 + i, 10) for i, m in enumerate(MONTHS)]
    rows += [(5, m, 50.0 + i % 3, 8) for i, m in enumerate(MONTHS) if m != 201903]
    df = spark.createDataFrame(rows, "STORE_NBR bigint, YEARMONTH int, totSales double, nCustomers bigint")
    table = spark.createDataFrame([(77, 5)], "trial bigint, control bigint")
    assessed = uplift.assess(uplift.paired_series(df, table), DESIGN)
    assert uplift.percentage_differences(assessed).count() == 11 * 2
    assert uplift.scaled_control(assessed).count() == 11 * 2
    assert uplift.trial_bands(assessed).count() == (12 + 3 * 11) * 2
    assert {r.months_total for r in uplift.trial_verdict(assessed, DESIGN).collect()} == {2}


def year_window(spark, root, columns):
    txns = tpch.transactions(spark, root, columns)
    return txns.filter(F.col("DATE").between(dt.date(1996, 7, 1), dt.date(1997, 6, 30)))


def test_control_stores_of_one_year(spark, small):
    """One year of the given tables: control stores measured independently beforehand."""
    txns = year_window(spark, small, ("DATE", "STORE_NBR", "LYLTY_CARD_NBR", "TOT_SALES"))
    design = stores.TrialDesign(trials=(6, 7, 8, 77, 86, 88), pre_end=199702, trial_start=199702, trial_end=199704, trend_end=199703)
    measures = stage(stores.with_observed_months(stores.sales_and_customers(txns), design))
    pre = stores.pre_trial_measures(measures, design)
    got = {r.Store1: r.Store2 for r in control.control_store(control.control_scores(pre, design)).collect()}
    assert got == {6: 86, 7: 79, 8: 32, 77: 21, 86: 27, 88: 52}


def test_price_test_of_one_year(spark, small):
    columns = ("DATE", "LYLTY_CARD_NBR", "PROD_QTY", "TOT_SALES")
    enriched = enrich(with_price(year_window(spark, small, columns)), tpch.customers(spark, small))
    chosen = enriched.filter(F.col("LIFESTAGE").isin("BUILDING", "MACHINERY"))
    main = F.col("PREMIUM_CUSTOMER") == "Mainstream"
    got = welch_greater(chosen, "price", main, ~main).first()
    assert got.t == pytest.approx(-1.268283, abs=1e-6) and got.df == pytest.approx(3452.0335, abs=1e-4)


def test_month_start_of_measures(world):
    _, df = world
    assert df.select(month_start(F.col("YEARMONTH"))).distinct().count() == 12


def test_deviation_of_a_single_month_is_missing(spark):
    rows = [(s, m, 10.0 * s, 5) for s in (77, 5) for m in (201901, 201902)]
    df = spark.createDataFrame(rows, "STORE_NBR bigint, YEARMONTH int, totSales double, nCustomers bigint")
    table = spark.createDataFrame([(77, 5)], "trial bigint, control bigint")
    assessed = uplift.assess(uplift.paired_series(df, table), DESIGN).collect()
    assert {(r.sd_pre, r.tValue, r.upper) for r in assessed} == {(None, None, None)}


def test_month_of_equal_stores_is_left_out_of_the_closeness(spark):
    rows = [(s, m, float(s if i else 5), s) for s in (77, 1, 2) for i, m in enumerate(MONTHS)]
    df = spark.createDataFrame(rows, "STORE_NBR bigint, YEARMONTH int, totSales double, nCustomers bigint")
    pre = eligible_before(df)
    got = {r.Store2: r.mag_measure for r in control.store_magnitude(pre, [77], [SALES]).collect()}
    assert got == {77: 1.0, 1: 0.0, 2: pytest.approx(1 - 75 / 76)}


def test_nan_score_is_never_chosen(spark):
    rows = [(77, 1, 0.9), (77, 2, float("nan")), (77, 3, 0.8), (88, 1, float("nan")), (88, 2, None), (88, 4, -1.0)]
    scores = spark.createDataFrame(rows, "Store1 bigint, Store2 bigint, finalControlScore double")
    got = {r.Store1: r.Store2 for r in control.control_store(scores).collect()}
    assert got == {77: 1, 88: 4}


def test_nan_and_missing_sales_are_alike(spark):
    def measured(value):
        rows = [(dt.date(2019, 1, 5), 77, 1, 1, "a", 1.0, 5.0), (dt.date(2019, 1, 6), 77, 2, 2, "a", 1.0, value)]
        txns = spark.createDataFrame(rows, "DATE date, STORE_NBR bigint, LYLTY_CARD_NBR bigint, TXN_ID bigint, PROD_NAME string, PROD_QTY double, TOT_SALES double")
        return stores.sales_and_customers(txns).collect(), stores.store_month_measures(txns).collect()

    assert measured(float("nan")) == measured(None)
    assert measured(None)[0][0].totSales == 5.0


def test_plan_is_the_same_for_any_number_of_trials(world):
    _, df = world
    pre = eligible_before(df)

    def shape(trials):
        plan = control.control_store(control.control_scores(pre, stores.TrialDesign(trials=trials)))
        return re.findall(r"(\w+(?:Join|Exchange|Aggregate|Window))\b", plan._jdf.queryExecution().executedPlan().toString())

    assert shape((77, 86, 88)) == shape(tuple(range(77, 89)))


def test_trend_of_many_trials_does_not_multiply_the_measures(spark):
    rows = [(s, m, float(s + i), s % 7 + 1) for s in range(120) for i, m in enumerate(MONTHS)]
    df = spark.createDataFrame(rows, "STORE_NBR bigint, YEARMONTH int, totSales double, nCustomers bigint")
    pairs = {s: s + 60 for s in range(50)}
    table = spark.createDataFrame(list(pairs.items()), "trial bigint, control bigint")
    got = uplift.store_type_trend(df, table, DESIGN).collect()
    before = [m for m in MONTHS if m < DESIGN.trend_end]
    assert len(got) == 50 * len(before) * 3
    for r in got:
        if r.Store_type == "Other stores":
            values = [v for s, m, v, _ in rows if m == r.YEARMONTH and s not in (r.trial, pairs[r.trial])]
            assert r.totSales == pytest.approx(statistics.fmean(values))
