"""Exact quartiles from sketches and narrow passes."""

import random

import pytest
from pyspark.sql import functions as F

from basketry.operators import quantiles


def quantile(data, quarter):
    data = sorted(data)
    place, part = divmod((len(data) - 1) * quarter, 4)
    low, high = float(data[place]), float(data[place + 1 if part else place])
    return low if low == high else low + (high - low) * part / 4


def expected(data):
    return [quantile(data, q) for q in (1, 2, 3)] if data else [None] * 3


def found(df, columns):
    base = df.select(*columns)
    return quantiles.quartiles(base, quantiles.sketch_state(base, columns), columns)[1]


DATA = {
    "spread": [random.Random(1).gauss(0, 1e5) for _ in range(4000)],
    "one value": [3.5] * 900,
    "two values": [1.0] * 450 + [2.0] * 451,
    "ties around the ends": [1.0] * 700 + [random.Random(2).random() + 1 for _ in range(1500)] + [2.0] * 700,
    "few": [1.0, 2.0, 3.0, 10.0],
    "single": [7.0],
    "none": [],
    "steps": [float(i // 37) for i in range(3000)],
    "infinite": [float("-inf")] * 5 + [float(i) for i in range(100)] + [float("inf")] * 90,
}


@pytest.mark.parametrize("fetched", [0, 5, 10_000])
def test_quartiles_equal_sorted_data(spark, monkeypatch, fetched):
    """Small sketches and few fetched values force many rounds."""
    monkeypatch.setattr(quantiles, "_FETCHED", fetched)
    if fetched < 10_000:
        monkeypatch.setattr(quantiles, "SIZE", 16)
        monkeypatch.setattr(quantiles, "_STEPS", 4)
    for name in DATA if fetched == 10_000 else ("spread", "ties around the ends", "few"):
        data = DATA[name]
        rows = [(x, None if i % 3 else int(x * 1000) + 2**60 if abs(x) < 1e9 else None) for i, x in enumerate(data)]
        df = spark.createDataFrame(rows, "x double, k bigint").repartition(4)
        got = found(df, ["x", "k"])
        assert got["x"] == expected(data), name
        assert got["k"] == expected([k for _, k in rows if k is not None]), name


def test_a_wrong_bracket_is_widened(spark):
    """Whatever the sketch says, the passes find the value."""
    df = spark.range(10_000).select(F.col("id").alias("k"))
    for low, high in ((9000, 9500), (0, 1), (5000, 5000), (9999, 9999), (0, 9999), (4990, 5010)):
        w = quantiles._Wanted("k", "bigint", 5001, 0, 9999, low, high)
        for _ in range(40):
            if w.value is None:
                quantiles._placed(w, quantiles._counted(df, [w])[w.key])
            if w.place is not None:
                quantiles._looked_at(df, [w])
        assert w.value == 5000


def test_state_of_parts_merges(spark):
    rng = random.Random(4)
    rows = [(rng.randint(1, 5), rng.choice([None, rng.gauss(10, 5)]), rng.randint(-5, 10**12)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "m int, x double, k bigint")
    state = quantiles.sketch_state(df, ["x", "k"], by=["m"])
    parts = [2, 5]
    got = {r.column: r for r in quantiles.summary_of_parts(df, state, ["x", "k"], "m", parts).collect()}
    for column, place in (("x", 1), ("k", 2)):
        data = [r[place] for r in rows if r[0] in parts and r[place] is not None]
        mine = got[column]
        assert [mine.q1, mine.median, mine.q3] == expected(data) and mine.n == len(data)
        assert (mine.min, mine.max) == (min(data), max(data)) and mine.mean == pytest.approx(sum(data) / len(data))
    assert got["x"].n + got["x"].n_null == sum(1 for r in rows if r[0] in parts)
    halves = quantiles.merge_sketches(state.withColumn("h", F.col("m") > 2), ["x", "k"], by=["h"])
    whole = quantiles.merge_sketches(halves, ["x", "k"])
    assert quantiles.quartiles(df, whole, ["x", "k"])[1]["k"] == expected([r[2] for r in rows])
    none = quantiles.summary_of_parts(df, state, ["x", "k"], "m", [9]).collect()
    assert [(r.n, r.n_null, r.min, r.median, r.mean) for r in none] == [(0, 0, None, None, None)] * 2


def test_input_is_read_once_and_nothing_is_sorted_in_one_task(spark):
    df = spark.range(50_000).select((F.xxhash64("id") % 1_000_003).alias("k"))
    seen = []

    def spy(base, wanted):
        seen.append(len(wanted))
        return counted(base, wanted)

    counted, quantiles._counted = quantiles._counted, spy
    try:
        got = quantiles.numeric_summary(df, ["k"]).first()
    finally:
        quantiles._counted = counted
    assert [got.q1, got.median, got.q3] == df.select(F.expr("percentile(k, array(0.25D, 0.5D, 0.75D))")).first()[0]
    assert len(seen) <= 2
