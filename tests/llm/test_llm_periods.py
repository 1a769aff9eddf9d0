import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from basketry.llm import periods


def brute_force(words, least=12):
    """Every stretch of equal distances, for every distance; equal stretches once, with the smallest."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def rewritten(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digests(doc_id, text):
    words = rewritten(doc_id, (text or "").encode().split())
    runs = brute_force(words)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
    return (
        doc_id, len(runs), *best, best[1] * 1000 // best[2] if runs else None,
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in drop)).hexdigest(),
    )


def found_in(texts, least=12):
    sizes = np.array([len(t) for t in texts], np.int64)
    runs = periods.runs_of(np.array([w for t in texts for w in t], np.int64), sizes, least)
    got = [[] for _ in texts]
    for row, *run in zip(runs.row.tolist(), runs.start.tolist(), runs.length.tolist(), runs.period.tolist(), strict=True):
        got[row].append(tuple(run))
    return got


def test_runs_equal_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(150):
        texts = []
        for _ in range(rng.integers(1, 6)):
            n = int(rng.integers(0, 150))
            text = rng.integers(0, int(rng.choice([1, 2, 3, 40])), n).tolist()
            if n and rng.random() < 0.7:
                a = int(rng.integers(0, n))
                p = 1 + int(rng.integers(0, max(1, (n - a) // 2)))
                for i in range(a, int(rng.integers(a, n + 1))):
                    text[i] = text[a + (i - a) % p]
            texts.append(text)
        assert found_in(texts) == [brute_force(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0, 1, 2]), max_size=9).flatmap(lambda u: st.integers(1, 5).map(lambda k: u * k)), max_size=8))
def test_runs_of_repeated_parts(parts):
    text = [w for part in parts for w in part]
    assert found_in([text, text[::-1]]) == [brute_force(text), brute_force(text[::-1])]


@pytest.mark.parametrize("period", [1, 2, 5, 6, 7, 14, 15, 31, 33, 100])
@pytest.mark.parametrize("copies", [2, 2.5, 7])
def test_every_period_and_place(period, copies):
    length = max(12, int(period * copies))
    base = list(range(1000, 1000 + period))
    for before in range(0, 40, 3):
        text = [-1 - i for i in range(before)] + [base[i % period] for i in range(length)] + [1, 2, 3]
        assert found_in([text]) == [[(before, length, period)]]


def test_long_runs_take_little_work():
    n = 60_000
    assert found_in([[0] * n, [0] * n + [1], [0, 1] * (n // 2)]) == [[(0, n, 1)], [(0, n, 1)], [(0, n, 2)]]


def test_transforms_locate_blocks():
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 3, (50, 4)).astype(np.uint64)
    windows = rng.integers(0, 3, (50, 11)).astype(np.uint64)
    got = periods.zero_mismatches(blocks, windows)
    want = [[(w[t : t + 4] == b).all() for t in range(8)] for b, w in zip(blocks, windows, strict=True)]
    assert got.tolist() == np.array(want).tolist() and got.any()
    rows = rng.integers(0, periods._PRIME, (3, 64)).astype(np.uint64)
    assert (periods._back(periods._transform(rows)) == rows).all()


def test_query_equals_brute_force(spark, tmp_path, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    rows = [(i, " ".join((t or "").split()[:400])) for i, t in rows]
    rows += [(i, "a  b\tc\n" * (i % 30)) for i in range(1000, 1200)] + [(None, "x " * 20), (5, None), (6, ""), (6, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in periods.op12_periodic_runs(spark, str(tmp_path)).collect()]
    want = [digests(i, t) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(1 for r in want if r[1]) > 100


def test_odd_rows(odd, nothing, monkeypatch):
    monkeypatch.setattr(periods, "_BYTES", 30)
    got = periods.periodic_runs(odd).collect()
    assert len(got) == 9 and periods.periodic_runs(nothing).collect() == []
    long = next(r for r in got if r.doc_id == 5)
    assert [tuple(r) for r in long.runs] == [(0, 20_000, 5_000)]
    assert long.collapsed == " ".join(f"w{i}" for i in range(5000))
    assert {r.collapsed for r in got if r.doc_id in (1, 2, 3)} == {""}
