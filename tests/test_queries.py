"""Every named query against its SQL, and what its plan must not contain."""

import os
import re

import pytest
from compare import database, difference, load_entry

from basketry.plans import customer_review, handoff, store_trial
from basketry.plans.duckdb_sql import statements

ENTRY = load_entry()
SQL = statements()
QUERIES = {**{q.__name__: q for q in customer_review.QUERIES}, **store_trial.QUERIES, **handoff.QUERIES}
ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas")


@pytest.fixture(scope="module")
def con():
    return database(ROOT)


def test_every_query_has_sql_and_is_registered():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(ENTRY.queries()) and set(SQL) <= set(ENTRY.oracle_sql())


@pytest.mark.parametrize("key", list(QUERIES))
def test_query_equals_sql(spark, con, key):
    """Equal rows; no loop over all pairs and no Python in the plan."""
    df = QUERIES[key](spark, ROOT)
    assert difference(df, con, SQL[key]) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in FORBIDDEN if node in plan]


def test_entry(spark):
    df = ENTRY.entry(spark)
    assert df.count() == 6
    assert df.columns == ["trial", "metric", "months_outside", "months_total", "significant_months"]


@pytest.mark.parametrize("key", ["price_histogram_by_group", "pack_size_histogram", "brand_affinity"])
def test_lines_are_read_once(spark, key):
    """Range and bins come from the same shuffle: one scan in the final plan and one in the initial."""
    df = QUERIES[key](spark, ROOT)
    df.collect()
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = df._jdf.queryExecution().explainString(mode)
    assert text.count("lineitem.parquet") == 2


@pytest.mark.parametrize("key", ["product_counts", "product_words"])
def test_lines_are_added_up_before_they_meet_the_names(spark, key):
    plan = QUERIES[key](spark, ROOT)._jdf.queryExecution().optimizedPlan().toString()
    per_key = re.search(r"Aggregate \[(_part|l_partkey)#", plan)
    assert per_key and plan.index("Join") < per_key.start()
