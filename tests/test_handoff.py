"""Distinct counts as state, and the hand-off in buckets, by month and with checks."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from basketry.functions.dates import yearmonth
from basketry.operators import members, stores
from basketry.sources import handoff

SCHEMA = (
    "DATE date, STORE_NBR bigint, LYLTY_CARD_NBR bigint, TXN_ID bigint, PROD_NAME string, "
    "PROD_QTY double, TOT_SALES double"
)
NAN = float("nan")


def lines(seed=5, n=900, months=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        store = 1 if i % 3 == 0 else rng.randint(2, 6)  # one store holds a third
        card = None if i % 41 == 0 else rng.choice([rng.randint(-3, 60), rng.randint(10**9, 10**9 + 10**5)])
        day = dt.date(2018, 7, 1) + dt.timedelta(days=rng.randint(0, 30 * months - 1))
        rows.append((day, store, card, rng.randint(1, 300), rng.choice(["Old Chips 150g", "Salsa 1g", None]),
                     rng.choice([1.0, 2.0, 5.0, None]), rng.choice([1.5, 3.0, NAN, 7.25])))
    return rows


@pytest.fixture(scope="module")
def txns(spark):
    return spark.createDataFrame(lines(), SCHEMA).repartition(5)


def expected(rows):
    """Measures per store and month, plainly."""
    groups = {}
    for row in rows:
        groups.setdefault((row[1], row[0].year * 100 + row[0].month), []).append(row)
    found = {}
    for key, mine in groups.items():
        sales = [r[6] for r in mine if r[6] == r[6]]
        units = [r[5] for r in mine if r[5] is not None]
        cards, baskets = len({r[2] for r in mine}), len({r[3] for r in mine})
        total, n = (sum(sales) if sales else None), (sum(units) if units else None)
        found[key] = (total, cards, baskets / cards, None if n is None else n / baskets, None if None in (total, n) else total / n)
    return found


def measured(df):
    return {(r.STORE_NBR, r.YEARMONTH): pytest.approx(tuple(r)[2:], nan_ok=True) for r in df.collect()}


# --- state of distinct members ------------------------------------------------------------


@pytest.mark.parametrize("listed", [0, 3, 2048])
def test_members_equal_sets(spark, txns, monkeypatch, listed):
    monkeypatch.setattr(members, "LISTED", listed)
    state = members.member_state(txns.withColumn("m", yearmonth(F.col("DATE"))), ["STORE_NBR", "m"], "LYLTY_CARD_NBR")
    sets = {}
    for row in lines():
        for key in (("a",), (row[1],), (row[1], row[0].year * 100 + row[0].month)):
            sets.setdefault(key, set()).add(row[2])
    exact = {(r.STORE_NBR, r.m): r.members for r in members.count_members(state, ["STORE_NBR", "m"]).collect()}
    assert exact == {k: len(v) for k, v in sets.items() if len(k) == 2}
    by_store = members.merge_members(state, ["STORE_NBR"])
    assert {(r.STORE_NBR,): r.members for r in members.count_members(by_store, ["STORE_NBR"]).collect()} == {
        k: len(v) for k, v in sets.items() if len(k) == 1 and k != ("a",)
    }
    # States merge in any grouping.
    whole = members.distinct_over(by_store.withColumn("a", F.lit("a")), ["a"]).collect()
    assert whole[0].members == len(sets["a",]) and len(whole) == 1


def test_thin_buckets_are_listed_and_full_ones_are_bitmaps(spark):
    df = spark.range(0, 100_000).select(F.lit(1).alias("k"), "id").union(spark.createDataFrame([(2, 7), (2, 10**12), (2, None)], "k int, id bigint"))
    state = members.member_state(df, ["k"], "id").collect()
    assert all((r.positions is None) != (r.bitmap is None) or r.bucket is None for r in state)
    full = [r for r in state if r.k == 1 and r.bitmap is not None]
    assert len(full) == 3 and all(len(r.bitmap) == 4096 for r in full)  # the last 1,695 ids are listed
    assert sorted(len(r.positions) for r in state if r.k == 2 and r.bucket is not None) == [1, 1]
    counts = members.distinct_over(spark.createDataFrame(state, members.member_state(df, ["k"], "id").schema), ["k"])
    assert {r.k: r.members for r in counts.collect()} == {1: 100_000, 2: 3}


def test_members_of_no_rows(spark):
    none = spark.createDataFrame([], "k int, id bigint")
    assert members.distinct_over(members.member_state(none, ["k"], "id"), ["k"]).collect() == []


def test_counts_copy_no_line(spark, txns):
    """No Expand: the distinct counts don't multiply the lines."""
    for df in (stores.store_month_measures(txns), members.member_state(txns, ["STORE_NBR"], "LYLTY_CARD_NBR")):
        assert "Expand" not in df._jdf.queryExecution().executedPlan().toString()


def test_measures_equal_a_plain_computation(spark, txns):
    assert measured(stores.store_month_measures(txns)) == expected(lines())
    odd = spark.createDataFrame([(None, None, None, None, None, None, None)] * 2 + [(dt.date(2020, 1, 1), None, 1, 1, "a", 1.0, 2.0)], SCHEMA)
    got = {(r.STORE_NBR, r.YEARMONTH): (r.totSales, r.nCustomers, r.nTxnPerCust) for r in stores.store_month_measures(odd).collect()}
    assert got == {(None, None): (None, 1, 1.0), (None, 202001): (2.0, 1, 1.0)}


# --- buckets ------------------------------------------------------------------------------


def test_bucketed_handoff_is_read_without_exchange(spark, txns):
    handoff.write_bucketed(txns, "bucketed_lines", 8)
    table = spark.table("bucketed_lines")
    assert table.drop("YEARMONTH").exceptAll(txns).isEmpty() and table.count() == txns.count()
    for df in (stores.store_month_measures(table, co_located=True), stores.sales_and_customers(table)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
    assert measured(stores.store_month_measures(table, co_located=True)) == expected(lines())
    files = {os.path.basename(r.f) for r in table.select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(files) <= 8
    handoff.write_bucketed(txns.limit(0), "bucketed_none", 4)
    assert spark.table("bucketed_none").isEmpty()


def test_bucketed_handoff_refuses_rows_without_store(spark, txns):
    with pytest.raises(Exception, match="no store or date"):
        handoff.write_bucketed(txns.withColumn("STORE_NBR", F.lit(None).cast("bigint")), "bucketed_bad", 4)


# --- months -------------------------------------------------------------------------------


def scanned(spark, make):
    """Bytes of the files that the scans of a plan read."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the scans are then leaves of the plan
    try:
        df = make()
        df.collect()
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        scans = [leaves.apply(i).metrics() for i in range(leaves.size())]
        return sum(m.apply("filesSize").value() for m in scans if m.contains("filesSize"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_restated_month_equals_a_rebuild(spark, txns, tmp_path):
    kept = handoff.MonthlyHandoff(spark, str(tmp_path / "kept"))
    rows = lines()
    assert kept.update(txns) == [201807, 201808, 201809, 201810]
    assert measured(kept.measures()) == expected(rows)

    def files():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(tmp_path / "kept") for f in fs
                if "incoming" not in d and f.startswith("part-")}

    before = files()
    assert kept.update(txns.repartition(3)) == [] and files() == before  # a repeated delivery changes nothing
    changed = [r for r in rows if r[0].month == 8][:50]
    new = [(dt.date(2018, 11, 3), 9, 5, 1, "a", 1.0, 2.0)]
    assert kept.update(spark.createDataFrame(changed + new, SCHEMA)) == [201808, 201811]
    after = files()
    untouched = {f for f in before if "YEARMONTH=201808" not in f}
    assert all(after.get(f) == before[f] for f in untouched)
    now = [r for r in rows if r[0].month != 8] + changed + new
    assert measured(kept.measures()) == expected(now)
    rebuilt = handoff.MonthlyHandoff(spark, str(tmp_path / "rebuilt"))
    rebuilt.update(spark.createDataFrame(now, SCHEMA))
    assert measured(rebuilt.measures()) == measured(kept.measures()) or measured(rebuilt.measures()) == expected(now)
    for part in ("cards", "baskets"):
        assert kept.members(part).exceptAll(rebuilt.members(part)).isEmpty()
    assert [r.n for r in kept.manifest().orderBy("YEARMONTH").collect()] == [r.n for r in rebuilt.manifest().orderBy("YEARMONTH").collect()]


def test_months_without_rows_and_any_set_of_months(spark, txns, tmp_path):
    kept = handoff.MonthlyHandoff(spark, str(tmp_path))
    rows = lines()
    kept.update(txns)
    assert kept.update(txns.limit(0), months=[201809, 201901]) == [201809, 201901]
    now = [r for r in rows if r[0].month != 9]
    assert measured(kept.measures()) == expected(now)
    assert kept.update(txns.limit(0), months=[201809]) == []
    some = [201807, 201810]
    got = {r.STORE_NBR: r.nCustomers for r in kept.customers(some).collect()}
    want = {}
    for r in now:
        if r[0].month in (7, 10):
            want.setdefault(r[1], set()).add(r[2])
    assert got == {k: len(v) for k, v in want.items()}
    assert measured(kept.measures([201807])) == expected([r for r in now if r[0].month == 7])
    # The month filter prunes folders: fewer bytes are read than the state of all months has.
    one, all_of_them = scanned(spark, lambda: kept.customers([201807])), scanned(spark, kept.customers)
    assert 0 < one < all_of_them / 2
    assert kept.update(spark.createDataFrame([r for r in rows if r[0].month == 9], SCHEMA)) == [201809]
    assert measured(kept.measures()) == expected(rows)


def test_update_refuses_rows_without_date(spark, tmp_path):
    kept = handoff.MonthlyHandoff(spark, str(tmp_path))
    assert kept.update(spark.createDataFrame([], SCHEMA)) == []
    with pytest.raises(ValueError):
        kept.update(spark.createDataFrame([(None, 1, 1, 1, "a", 1.0, 1.0)], SCHEMA))


# --- checks -------------------------------------------------------------------------------


def test_checks_come_with_the_write(spark, txns, tmp_path):
    rows = txns.withColumn("LIFESTAGE", F.when(F.col("LYLTY_CARD_NBR") > 10, "x"))
    got = handoff.write_checked(rows, str(tmp_path / "out"), "Salsa")
    plain = lines()
    assert got["n"] == len(plain) == spark.read.parquet(str(tmp_path / "out")).count()
    assert got["n_days"] == len({r[0] for r in plain})
    assert (got["first_day"], got["last_day"]) == (min(r[0] for r in plain), max(r[0] for r in plain))
    assert got["null_TOT_SALES"] == sum(1 for r in plain if r[6] != r[6])
    assert got["null_PROD_QTY"] == sum(1 for r in plain if r[5] is None)
    assert got["n_excluded"] == sum(1 for r in plain if r[4] and "Salsa" in r[4])
    assert got["n_unmatched"] == got["null_LIFESTAGE"] == sum(1 for r in plain if r[2] is None or r[2] <= 10)


def test_checks_need_no_job_of_their_own(spark, txns, tmp_path):
    """As many jobs as the same write without checks."""
    rows = txns.withColumn("LIFESTAGE", F.lit("x"))

    def jobs(name, run):
        spark.sparkContext.setJobGroup(name, name)
        run()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    def plain():
        keyed = rows.withColumn("YEARMONTH", yearmonth(F.col("DATE"))).hint("rebalance", "YEARMONTH")
        keyed.write.partitionBy("YEARMONTH").parquet(str(tmp_path / "plain"))

    checked = jobs("checked", lambda: handoff.write_checked(rows, str(tmp_path / "out"), "Salsa"))
    assert checked == jobs("plain", plain)


def test_checks_of_no_rows_and_far_dates(spark, txns, tmp_path):
    none = handoff.write_checked(txns.limit(0).withColumn("LIFESTAGE", F.lit("x")), str(tmp_path / "none"), "Salsa")
    assert none["n"] == none["n_days"] == 0 and none["first_day"] is None
    with pytest.raises(ValueError):
        far = spark.createDataFrame([(dt.date(1950, 1, 1), 1, 1, 1, "a", 1.0, 1.0)], SCHEMA).withColumn("LIFESTAGE", F.lit("x"))
        handoff.write_checked(far, str(tmp_path / "far"), "Salsa")


# --- work of a task, whatever the table's size ------------------------------------------------


def test_state_and_merge_build_no_bitmap_for_thin_buckets(spark):
    """Neither aggregates 4 KB per thin bucket; a state takes one exchange, not merged down to the cores."""
    state = members.member_state(spark.createDataFrame(lines(), SCHEMA), ["STORE_NBR"], "LYLTY_CARD_NBR")
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert "bitmap_construct_agg" not in plan and plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") == 1
    merged = members.merge_members(state.withColumn("a", F.lit("a")), ["a"])
    assert "bitmap_construct_agg" not in merged._jdf.queryExecution().executedPlan().toString()


def test_bits_are_set_as_the_bitmap_aggregate_sets_them(spark):
    rng = random.Random(3)
    cases = [([], []), ([0, 7, 8, 63, 64, 32767], []), ([], [5, 63]), ([56, 63, 32704], [0, 57, 70, 32767])]
    cases += [(rng.sample(range(32768), n), rng.sample(range(32768), 300)) for n in (1, 40, 5000, 32768)]
    rows = [(i, sorted(new), sorted(old)) for i, (new, old) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, new array<smallint>, old array<smallint>")

    def whole(column):
        return df.select("i", F.explode(column).alias("p")).groupBy("i").agg(F.bitmap_construct_agg(F.col("p").cast("bigint")).alias("b"))

    want = {r.i: bytes(r.b) for r in whole(F.concat("new", "old")).collect()}
    base = whole(F.col("old"))
    got = df.join(base, "i", "left").select("i", members._with_bits(F.col("b"), F.col("new")).alias("b")).collect()
    assert {r.i: bytes(r.b) for r in got} == {i: want.get(i, bytes(4096)) for i in range(len(rows))}


def test_lists_and_bitmaps_of_a_bucket_merge(spark):
    """One key has a bitmap and the other a list of the same bucket; a third part is listed alone."""
    df = spark.range(0, 6000).select(F.lit(1).alias("k"), "id").union(
        spark.createDataFrame([(2, i) for i in (5999, 6000, 32767, 40000, None)], "k int, id bigint")
    )
    state = members.member_state(df, ["k"], "id").withColumn("a", F.lit("a"))
    merged = members.merge_members(state, ["a"])
    rows = {r.bucket: r for r in merged.collect()}
    assert set(rows) == {0, 1, 2, None} and sum(b.bit_count() for b in bytes(rows[1].bitmap)) == 6001
    assert members.count_members(merged, ["a"]).first().members == 6000 + 3 + 1


def test_buckets_follow_the_rows(spark, tiny, monkeypatch):
    assert [handoff.buckets_for(n, 16) for n in (0, 8_000_000, 8_000_001, 216_000_000)] == [16, 16, 17, 432]
    from basketry.plans import handoff as plans

    seen = []
    write = handoff.write_bucketed
    monkeypatch.setattr(handoff, "BUCKET_ROWS", 250)
    monkeypatch.setattr(handoff, "write_bucketed", lambda df, table, buckets: (seen.append(buckets), write(df, table, buckets)))
    n = plans.store_measures_bucketed(spark, tiny).count()
    lines = spark.read.parquet(f"{tiny}/lineitem.parquet").count()
    assert n > 0 and seen == [-(-lines // 250)] and seen[0] > 16


def test_measures_deal_customers_and_baskets_out(spark, txns):
    """Sums per customer and distinct transactions lie behind exchanges that adaptive execution doesn't merge."""
    plan = stores.store_month_measures(txns)._jdf.queryExecution().executedPlan().toString()
    for ids in ("LYLTY_CARD_NBR", "TXN_ID"):
        assert any(ids in line and "REPARTITION_BY_NUM" in line for line in plan.splitlines())
