"""Both analyses from files to verdict, with the original run's parameters."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from basketry.plans import pipelines
from basketry.sources import tables

EPOCH = dt.date(1899, 12, 30)
CHRISTMAS = dt.date(2018, 12, 25)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """One year of sales in 13 stores, without Christmas, with the outlier card and salsa."""
    rng = random.Random(2)
    folder = tmp_path_factory.mktemp("shop")
    products = ["WW Original 90g", "Smith Crinkle 170g", "Twisties Cheese 270g", "Old El Paso Salsa 300g", "Tyrrells Sea 165g"]
    lines = ["DATE,STORE_NBR,LYLTY_CARD_NBR,TXN_ID,PROD_NAME,PROD_QTY,TOT_SALES"]
    day, number = dt.date(2018, 7, 1), 0
    while day <= dt.date(2019, 6, 30):
        for store in (77, 86, 88, *range(1, 11)):
            # Store 1 sells one known product every day.
            if day != CHRISTMAS and (store == 1 or rng.random() < 0.5):
                number += 1
                qty = rng.randint(1, 3)
                name = products[2] if store == 1 else rng.choice(products)
                sales = qty * rng.choice([3.0, 3.3, 4.6])
                lines.append(f"{(day - EPOCH).days},{store},{rng.randint(1, 60)},{number},{name},{qty},{sales}")
        day += dt.timedelta(days=1)
    for _ in range(2):
        number += 1
        lines.append(f"{(dt.date(2018, 8, 19) - EPOCH).days},4,226000,{number},Twisties Cheese 270g,200,650")
    (folder / "transactions.csv").write_text("\n".join(lines) + "\n")
    stages = ["YOUNG SINGLES/COUPLES", "MIDAGE SINGLES/COUPLES", "RETIREES"]
    people = ["LYLTY_CARD_NBR,LIFESTAGE,PREMIUM_CUSTOMER"]
    people += [f"{c},{stages[c % 3]},{('Mainstream', 'Budget', 'Premium')[c // 3 % 3]}" for c in range(1, 61)]
    (folder / "customers.csv").write_text("\n".join(people) + "\n")
    return folder


@pytest.fixture(scope="module")
def inputs(spark, files):
    txns = tables.read_transactions(spark, str(files / "transactions.csv"), "csv", serial_dates=True)
    return txns, tables.read_customers(spark, str(files / "customers.csv"))


@pytest.fixture(scope="module")
def enriched(spark, inputs, files):
    return pipelines.prepare(*inputs, str(files / "enriched"))


def test_profile(inputs):
    got = pipelines.profile(*inputs)
    assert got["excluded_products_left"].count() == 0
    assert got["quantity_outliers"].count() == got["outlier_customer_rows"].count() == 2
    assert [r.DATE for r in got["missing_days"].collect()] == [CHRISTMAS]
    assert got["days"].count() == 365 and got["december"].count() == 31
    assert got["repeat_customers"].count() == 50
    assert got["cards"].count() == 61
    quality = got["join_quality"].first()
    assert quality.n_left == quality.n_joined and quality.n_unmatched == 0
    for name, df in got.items():
        assert df.columns and df.limit(1).count() <= 1, name


def test_summaries(inputs):
    got = pipelines.summaries(*inputs)
    before, after = ({r.column: r for r in got[k].collect()} for k in ("before", "after"))
    assert before["PROD_QTY"].max == 200 and after["PROD_QTY"].max == 3
    assert before["TXN_ID"].n == after["TXN_ID"].n + 2
    assert got["customers"].first()["max"] == 60


def test_review(enriched):
    got = pipelines.review(enriched)
    assert {r.BRAND for r in got["brands"].collect()} == {"WOOLWORTHS", "SMITHS", "TWISTIES", "TYRRELLS"}
    assert [r.PACK_SIZE for r in got["pack_sizes"].collect()] == [270, 170, 165, 90]
    assert [r.PROD_NAME for r in got["pack_size_products"].collect()] == ["Twisties Cheese 270g"]
    assert got["sales"].count() == 9
    assert got["sales_shares"].agg(F.sum("share_total")).first()[0] == pytest.approx(1)
    assert got["customers"].agg(F.sum("CUSTOMERS")).first()[0] == 60
    assert got["brand_affinity"].count() == got["pack_affinity"].count() == 4
    assert 0 < got["price_test"].first().p_value < 1
    assert got["price_histogram"].agg(F.sum("count")).first()[0] == enriched.count()
    assert got["pack_size_histogram"].count() == 30
    assert {r.n_null for r in got["null_counts"].collect()} == {0}
    assert [r["rank"] for r in pipelines.brand_ranking(enriched).orderBy("rank").collect()] == [1, 2, 3, 4]


@pytest.mark.parametrize("as_written", [False, True])
def test_trial(enriched, as_written):
    got = pipelines.trial(enriched, as_written=as_written)
    assert got["full_observation_stores"].count() == 13
    assert got["measures"].count() == 13 * 12
    assert got["scores"].count() == 3 * 13
    controls = {r.Store1: r.Store2 for r in got["controls"].collect()}
    assert set(controls) == {77, 86, 88} and all(a != b for a, b in controls.items())
    assert got["bands"].count() == 3 * 2 * 12 * 4
    verdict = got["verdict"].collect()
    assert len(verdict) == 6 and {r.months_total for r in verdict} == {3}
    assert {round(r.t_crit, 2) for r in got["t_values"].collect()} == {1.89}
    for name in ("correlation", "magnitude", "trend", "factors", "scaled_control", "differences", "window"):
        assert got[name].count() > 0
