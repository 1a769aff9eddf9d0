"""Quality classifier by importance resampling with hashed n-gram models."""

from __future__ import annotations

import operator
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.llm.shared import map_batches, stage

#: Buckets of byte trigrams, target documents that the target model is fitted on at most.
BUCKETS = 1 << 16
SAMPLE = 20_000
#: Counts of the raw model that the target model is given beforehand.
PRIOR = 10_000.0
#: N-grams that every document counts as, so that its length does not decide.
LENGTH = 200.0
UNIT = 2.0**24
SEED = 4

# After the trigram buckets: bigrams of whether a word repeats the one before it.
_EXTRA = 4
#: Values among which the driver looks for the last key that is drawn.
FEW = 50_000


def grams(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all texts one after the other, and how many each text has.

    A text has its byte trigrams, hashed, and for each pair of neighbouring words whether either
    repeats the word before it. Null has none.
    """
    parts: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if len(raw) > 2:
            b = np.frombuffer(raw, np.uint8).astype(np.uint32)
            trigram = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))
            with np.errstate(over="ignore"):
                parts.append(((trigram * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64))
            counts[k] += len(parts[-1])
        words = raw.split()
        if len(words) > 1:
            again = np.zeros(len(words), np.int64)
            again[1:] = np.fromiter(map(operator.eq, words, islice(words, 1, None)), np.int64, len(words) - 1)
            parts.append(BUCKETS + 2 * again[1:] + again[:-1])
            counts[k] += len(parts[-1])
    return (np.concatenate(parts) if parts else np.empty(0, np.int64)), counts


@dataclass(frozen=True)
class Importance:
    """Log ratio of target and raw model for each bucket, in whole parts of 1 / ``UNIT``.

    Sums of whole numbers are exact, so a text has the same weight in whatever batch it is scored.
    """

    ratio: np.ndarray

    def of(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log importance weight of each text, for ``LENGTH`` n-grams, and its number of n-grams."""
        buckets, counts = grams(texts)
        total = np.concatenate([[0], np.cumsum(self.ratio[buckets])])
        ends = np.cumsum(counts)
        return (total[ends] - total[ends - counts]) / (np.maximum(counts, 1) * UNIT) * LENGTH, counts


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Importance:
    """Both models in one pass over all texts.

    The raw model counts every document; the target model the documents labelled 1, of which at most
    ``sample`` are taken (by a hash of their id; this bound also limits what is broadcast). Tasks add
    up their counts and send one row per bucket; the driver gets one row per bucket. Without labelled
    documents both models agree.
    """
    good = labels.filter("quality = 1").select("doc_id").dropna().distinct()
    chosen = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumn("_target", F.lit(True))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left").select("text", "_target")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS + _EXTRA, np.int64), np.zeros(BUCKETS + _EXTRA, np.int64)
        for batch in batches:
            buckets, counts = grams(batch.column("text").to_pylist())
            raw += np.bincount(buckets, minlength=len(raw))
            mine = np.repeat([x is True for x in batch.column("_target").to_pylist()], counts)
            target += np.bincount(buckets[mine.astype(bool)], minlength=len(raw))
        held = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held), pa.array(raw[held]), pa.array(target[held])], names=["bucket", "raw", "target"]
        )

    counted = map_batches(rows, count, "bucket long, raw long, target long")
    sums = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.ones(BUCKETS + _EXTRA), np.zeros(BUCKETS + _EXTRA)
    for bucket, r, t in sums.collect():
        raw[bucket] += r
        target[bucket] = t
    if not target.any():
        return Importance(np.zeros(len(raw), np.int64))
    base = raw / raw.sum()
    model = (target + PRIOR * base) / (target.sum() + PRIOR)
    return Importance(np.round((np.log(model) - np.log(base)) * UNIT).astype(np.int64))


def gumbel(doc_ids: Sequence[int | None], texts: Sequence[str | None], seed: int) -> np.ndarray:
    """Standard Gumbel noise that document and seed determine."""
    drawn = [xxhash.xxh64_intdigest(f"{d}:{t or ''}".encode("utf-8", "surrogatepass"), seed) for d, t in zip(doc_ids, texts, strict=True)]
    u = ((np.array(drawn, np.uint64) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return -np.log(-np.log(u))


def scored(docs: DataFrame, model: Importance, seed: int = SEED, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, the columns in ``carry``, ``n_grams``, ``log_ratio`` and ``key``, the ratio with Gumbel noise.

    A text without n-grams has ratio 0 and no key.
    """
    taken = [c for c in carry if c not in {"doc_id", "n_grams", "log_ratio", "key"}]
    rows = docs.select(*dict.fromkeys(["doc_id", "text", *taken]))
    kept = ["doc_id", *taken]
    schema = T.StructType(
        [
            *[rows.schema[c] for c in kept],
            T.StructField("n_grams", T.LongType()),
            T.StructField("log_ratio", T.DoubleType()),
            T.StructField("key", T.DoubleType()),
        ]
    )
    shared = docs.sparkSession.sparkContext.broadcast(model.ratio)  # one number per bucket

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Importance(shared.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ratio, n = held.of(texts)
            key = ratio + gumbel(batch.column("doc_id").to_pylist(), texts, seed)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(n), pa.array(ratio), pa.array(key, mask=n == 0)],
                names=[*kept, "n_grams", "log_ratio", "key"],
            )

    return map_batches(rows, score, schema)


def kth_largest(values: DataFrame, k: int, few: int = FEW) -> float | None:
    """The k-th largest of a column of doubles (its only column), or None without values or where k is 0.

    Rounds of counts over 1024 equal ranges close in on it; the driver gets counts and, at the end, at
    most ``few`` values.
    """
    name = values.columns[0]
    values = values.dropna()
    n, low, high = values.agg(F.count(F.lit(1)), F.min(name), F.max(name)).first()
    k = min(k, n)
    if not k:
        return None
    inside = values
    while n > few and low < high:
        step = (high - low) / 1024
        bin_of = F.least(F.floor((F.col(name) - low) / step), F.lit(1023))
        found = inside.groupBy(bin_of.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("low"), F.max(name).alias("high"))
        for row in sorted(found.collect(), key=lambda r: -r["b"]):
            if k <= row["n"]:
                n, low, high = row["n"], row["low"], row["high"]
                break
            k -= row["n"]
        inside = inside.filter(F.col(name).between(low, high))
    if low == high:
        return low
    return sorted((r[0] for r in inside.collect()), reverse=True)[k - 1]


def cut(weights: Sequence[float], good: Sequence[bool]) -> float:
    """The weight that best parts good from other labelled documents: the middle of the best gap.

    Shares of both kinds count alike. With one kind only, nothing can be told apart: minus infinity.
    """
    order = np.argsort(weights, kind="stable")
    w, g = np.asarray(weights, float)[order], np.asarray(good, bool)[order]
    if not g.any() or g.all():
        return -np.inf
    right = np.concatenate([[0.0], np.cumsum(np.where(g, -1 / g.sum(), 1 / (~g).sum()))])
    edges = np.concatenate([[w[0] - 1], w, [w[-1] + 1]])
    right[1:-1][w[1:] == w[:-1]] = -np.inf  # no cut between equal weights
    best = np.flatnonzero(right == right.max())
    widest = best[np.argmax(edges[best + 1] - edges[best])]
    return float((edges[widest] + edges[widest + 1]) / 2)


def last_key(scores: DataFrame, labels: DataFrame, sample: int = SAMPLE, k: int | None = None) -> float | None:
    """The smallest key that is drawn by Gumbel top-k.

    By default k is the number of documents whose weight exceeds the cut that best parts the labelled
    documents; of these, at most ``sample`` of each kind go to the driver.
    """
    if k is None:
        marks = labels.select("doc_id", "quality").dropna().distinct()
        kinds = [marks.filter(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in ("quality = 1", "quality <> 1")]
        known = scores.filter("key is not null").join(F.broadcast(kinds[0].union(kinds[1])), "doc_id")  # at most 2 * sample rows
        rows = known.select("log_ratio", "quality").limit(2 * sample).collect()
        k = scores.filter(F.col("key").isNotNull() & (F.col("log_ratio") > cut([r[0] for r in rows], [r[1] == 1 for r in rows]))).count()
    return kth_largest(scores.select("key"), k)


def resampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, k: int | None = None, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that are drawn, unchanged.

    Documents are drawn without replacement in proportion to their importance weights: the k largest
    keys (log weight and Gumbel noise) are kept. Scores are staged; the rows themselves are scored once more
    and filtered where they are, so texts don't move. Rows that tie with the k-th key, which
    only equal rows do, are all kept. Empty and null texts are never drawn; an empty table stays empty;
    without labels, or with one kind of them, every document with n-grams is drawn.
    """
    model = fit(docs, labels, sample)
    scores = stage(scored(docs, model, seed).select("doc_id", "log_ratio", "key"))
    least = last_key(scores, labels, sample, k)
    if least is None:
        return docs.limit(0)
    again = scored(docs, model, seed, carry=docs.columns)
    return again.filter(F.col("key") >= least).select(*docs.columns)


def op4_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """Importance and decision for every document; target: documents labelled as of good quality."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = stage(scored(docs, fit(docs, labels)))
    least = last_key(scores, labels)
    kept = F.lit(False) if least is None else F.coalesce(F.col("key") >= least, F.lit(False))
    return scores.select("doc_id", "n_grams", F.round("log_ratio", 6).alias("log_ratio"), F.round("key", 6).alias("key"), kept.alias("kept"))
