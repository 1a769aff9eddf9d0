import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm import quality


@pytest.fixture(scope="module")
def labelled(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    fit_on, held_out = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    scores = quality.scored(docs, quality.fit(docs, fit_on))
    least = quality.last_key(scores, fit_on)
    rates = dict(scores.join(held_out, "doc_id").groupBy("quality").agg(F.avg((F.col("key") >= least).cast("double"))).collect())
    assert rates[1] > 0.97 and rates[0] < 0.1


def test_drawn_rows_are_unchanged_and_repeatable(labelled):
    docs, labels = labelled
    drawn = quality.resampled(docs, labels)
    assert drawn.columns == docs.columns and drawn.exceptAll(docs).isEmpty()
    assert sorted(r[0] for r in drawn.select("doc_id").collect()) == sorted(r[0] for r in quality.resampled(docs.repartition(5), labels).select("doc_id").collect())
    assert quality.resampled(docs, labels, k=17).count() == 17


def test_kth_largest(spark):
    values = spark.range(30_000).select((F.xxhash64("id") % 1000 / 7.0).alias("x"))
    ordered = sorted((r[0] for r in values.collect()), reverse=True)
    for k in (1, 2, 777, 15_000, 29_999, 30_000, 40_000):
        assert quality.kth_largest(values, k, few=100) == ordered[min(k, 30_000) - 1]
    assert quality.kth_largest(values, 0) is None and quality.kth_largest(values.limit(0), 3) is None


def test_cut_parts_kinds():
    assert quality.cut([1, 2, 8, 9], [False, False, True, True]) == 5
    assert quality.cut([1, 2, 2, 9], [False, True, False, True]) in (5.5, 1.5)
    assert quality.cut([1, 2], [True, True]) == quality.cut([], []) == -np.inf


def test_grams():
    buckets, counts = quality.grams(["abcd", None, "", "a a b", "ab"])
    assert counts.tolist() == [2, 0, 0, 3 + 2, 0] and len(buckets) == 7
    assert buckets[-2:].tolist() == [quality.BUCKETS + 2, quality.BUCKETS + 1]


def test_gumbel_is_standard():
    rng = random.Random(1)
    noise = quality.gumbel(list(range(20_000)), [str(rng.random()) for _ in range(20_000)], 4)
    assert noise.mean() == pytest.approx(0.5772, abs=0.03) and noise.std() == pytest.approx(1.2825, abs=0.03)


def test_odd_rows(odd, nothing, spark):
    labels = spark.createDataFrame([(4, 0), (5, 1), (6, 1), (None, 1), (7, None)], "doc_id long, quality int")
    got = quality.resampled(odd, labels)
    assert got.columns == odd.columns
    drawn = sorted((r.doc_id for r in got.collect()), key=str)
    assert drawn.count(6) == 2 and not {1, 2} & set(drawn)
    assert quality.resampled(odd, labels.limit(0)).filter("text is null or length(text) < 3").isEmpty()
    assert quality.resampled(nothing, labels).isEmpty()
