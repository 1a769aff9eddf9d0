import itertools
import re

import numpy as np
import pytest

from basketry.llm import lines


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(100):
        field = lines.Field(rng.normal(size=len(lines.FEATURES)), rng.normal(size=(2, 2)))
        sizes = [int(x) for x in rng.integers(1, 7, 3)]
        x = rng.normal(size=(sum(sizes), len(lines.FEATURES)))
        got, at = field.viterbi(x, np.repeat([0, 1, 2], sizes)), 0
        for n in sizes:
            e = x[at : at + n] @ field.emission

            def score(y, e=e, n=n, field=field):
                return sum(e[i] * y[i] for i in range(n)) + sum(field.transition[y[i], y[i + 1]] for i in range(n - 1))

            assert tuple(got[at : at + n]) == max(itertools.product([0, 1], repeat=n), key=score)
            at += n
    assert len(lines.UNFITTED.viterbi(np.empty((0, len(lines.FEATURES))), np.empty(0, np.int64))) == 0


def test_fit_raises_the_likelihood_and_learns():
    rng = np.random.default_rng(1)
    stretches = []
    for k in range(60):
        x = np.zeros((int(rng.integers(1, 9)), len(lines.FEATURES)))
        x[:, 0] = 1
        x[:, 1] = np.clip(rng.normal(0.6 if k % 2 else 0.1, 0.25, len(x)), 0, 1)
        stretches.append((x, 1 - k % 2))
    field = lines.fit_field(stretches)
    right = total = 0
    for x, y in stretches:
        right += (field.viterbi(x, np.zeros(len(x), np.int64)) == y).sum()
        total += len(x)
    assert right / total > 0.9 and field.emission[1] < 0
    assert field.transition[0, 0] + field.transition[1, 1] > field.transition[0, 1] + field.transition[1, 0]


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    parts = text.split("\n")
    duplicates = sum(1 for k, x in enumerate(parts) if re.search(r"[^\x20\x09-\x0D]", x) and x in parts[:k])
    places = {}
    for k in range(len(words) - 4):
        places.setdefault(tuple(words[k : k + 5]), []).append(k)
    repeated = len({p for v in places.values() if len(v) > 1 for k in v for p in range(k, k + 5)})
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), duplicates, repeated


@pytest.mark.parametrize("fitted", [False, True])
def test_measures_equal_brute_force(documents, spark, small, fitted):
    texts = ["a b c d e a b c d e", "x\n\nx\nx \nx", "é|#ü \t z\r\nq\x0bq", "", None, "one", "A B C D E F G H I J", "a a a a a a a a a a a", "\n\n", " \n "]
    docs = documents(list(enumerate(texts)))
    field = lines.UNFITTED
    if fitted:
        docs = docs.union(spark.read.parquet(f"{small}/documents.parquet").filter("doc_id > 700"))
        field = lines.fit(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    for r in lines.judged(docs, field).collect():
        want = measures(rows[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert len(r["labels"]) == (rows[r.doc_id] or "").count("\n") + 1
        assert r.kept == (not r.base_failed and r.content_words >= 0.5 * r.n_words)
        assert fitted or r.content_words == r.n_words


def test_held_out_accuracy(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    field = lines.fit(docs, labels.filter("doc_id % 2 = 0"))
    got = lines.judged(docs, field).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    good = [r.kept for r in got if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in got if r.quality == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.15


def test_odd_rows(odd, nothing, spark):
    labels = spark.createDataFrame([(4, 0), (5, 1), (None, 1), (7, None)], "doc_id long, quality int")
    field = lines.fit(odd, labels)
    assert lines.judged(odd, field).count() == 9
    assert lines.fit(odd, labels.limit(0)) is lines.UNFITTED and lines.fit(nothing, labels) is lines.UNFITTED
    assert lines.judged(nothing, field).isEmpty()
