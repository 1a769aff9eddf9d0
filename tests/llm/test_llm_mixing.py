import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from basketry.llm import mixing


def reshared(sizes, weights, most=3):
    """Targets step by step: those above their limit stop there, the rest is shared again."""
    fixed = {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        left, weight = sum(sizes) - sum(fixed.values()), sum(weights[i] for i in free)
        now = {i: left * weights[i] / weight for i in free}
        above = [i for i in free if now[i] > most * sizes[i]]
        if not above:
            return [fixed.get(i, now.get(i)) for i in range(len(sizes))]
        fixed |= {i: float(most * sizes[i]) for i in above}


def test_targets_equal_step_by_step():
    rng = np.random.default_rng(1)
    for _ in range(200):
        sizes = (rng.pareto(0.7, rng.integers(1, 12)) * 100).astype(int).tolist()
        if sum(sizes):
            weights = mixing.repeating_weights(len(sizes))
            assert mixing.targets(sizes, weights) == pytest.approx(reshared(sizes, weights))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 100, 4097])
def test_permutations(n):
    x, size = np.arange(n), np.full(n, n)
    a, b = (mixing.permuted(x, size, np.full(n, key, np.uint64)) for key in (5, 6))
    assert sorted(a) == sorted(b) == list(x)
    assert n < 50 or (a != b).any()


@pytest.fixture(scope="module")
def corpus(documents):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(int(rng.integers(0, 90)))), s) for i, s in enumerate(np.random.default_rng(4).choice(["a", "b", "c", "d"], 300, p=[0.6, 0.2, 0.1, 0.1]).tolist())]
    return rows, documents(rows)


def test_mix_meets_targets(corpus, spark):
    rows, docs = corpus
    made = mixing.mixture(docs, block=16, shard_blocks=32)
    taken = made.taken.collect()
    by_source = {i: sum(r.words for r in taken if r.src == i) for i in range(4)}
    for i, s in enumerate(made.sources):
        assert s.name == "abcd"[i] and abs(by_source[i] - s.target) <= 32
    uses = {}
    for r in taken:
        uses.setdefault((r.src, r.block, r["pass"]), set()).add((r.shard, r.slot))
    assert all(len(places) == 1 for places in uses.values())
    slots = {(r.shard, r.slot) for r in taken}
    shards = sorted({s for s, _ in slots})
    assert shards == list(range(len(shards)))
    for shard in shards[:-1]:
        assert sorted(slot for s, slot in slots if s == shard) == list(range(32))
    sizes = {i: len(t.split()) for i, t, _ in rows}
    words = {}
    for r in taken:
        words[r.doc_id] = words.get(r.doc_id, 0) + r.words
    assert all(n <= 3 * sizes[i] for i, n in words.items())
    again = mixing.mixture(docs.repartition(7), block=16, shard_blocks=32).taken
    assert sorted(map(tuple, again.select(sorted(again.columns)).collect())) == sorted(
        map(tuple, made.taken.select(sorted(made.taken.columns)).collect())
    )


def test_mixed_documents_hold_the_taken_words(corpus):
    rows, docs = corpus
    made = mixing.mixture(docs, block=16, shard_blocks=32)
    expected = {}
    texts = {i: t.split() for i, t, _ in rows}
    for r in sorted(made.taken.collect(), key=lambda r: r.first):
        expected.setdefault((r.doc_id, r["pass"]), []).extend(texts[r.doc_id][r.first : r.first + r.words])
    got = mixing.mixed_documents(docs, block=16, shard_blocks=32)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted((i, " ".join(w)) for (i, _), w in expected.items())
    assert got.filter(F.length("text") != F.col("n_chars")).isEmpty()


def test_mixed_passages_are_substrings_of_their_documents(documents):
    rng = np.random.default_rng(9)
    gaps = [" ", "\n", "\n\n    ", "\t", "  ", "\r\n"]
    rows = [(i, "\n" + "".join(f"d{i}w{k}é" + gaps[g] for k, g in enumerate(rng.integers(0, 6, int(rng.integers(0, 90))).tolist())), "ab"[i % 2]) for i in range(120)]
    docs, texts = documents(rows), {i: t for i, t, _ in rows}
    taken = {}
    for r in mixing.mixture(docs, block=16, shard_blocks=32).taken.collect():
        taken.setdefault((r.doc_id, r["pass"]), []).append((r.first, r.words))
    want = []
    for (i, _), ranges in taken.items():
        held = sorted(f + k for f, n in ranges for k in range(n))
        starts = [k for k in held if k - 1 not in held]
        for k in starts:
            end = next(e for e in range(k, len(texts[i])) if e + 1 not in held)
            want.append((i, texts[i][texts[i].index(f"d{i}w{k}é") : texts[i].index(f"d{i}w{end}é") + len(f"d{i}w{end}é")]))
    got = mixing.mixed_passages(docs, block=16, shard_blocks=32)
    assert got.columns == docs.columns and got.filter(F.length("text") != F.col("n_chars")).isEmpty()
    found = sorted((r.doc_id, r.text) for r in got.collect())
    assert found == sorted(want) and all(t in texts[i] for i, t in found)
    assert len(found) > len(taken) and any("\n\n    " in t for _, t in found)


def test_the_pipeline_mixes_passages(spark, documents):
    rows = [(i, "\n\n".join(f"line {k} of {i}\n    kept" for k in range(20)), "a") for i in range(30)]
    texts = {i: t for i, t, _ in rows}
    got = corpus_pipeline.mix_sources(spark, documents(rows), "").collect()
    assert got and all(r.text in texts[r.doc_id] for r in got)


def test_shards_follow_the_shares(spark):
    sources = [mixing.Source("a", 1, 1.0, 4000, 8000), mixing.Source("b", 1, 1.0, 9000, 2000)]
    rows = mixing.draw(spark, sources, shard_blocks=500).groupBy("shard").agg(F.count_if(F.col("src") == 0).alias("a"), F.count("*").alias("n")).collect()
    assert len(rows) == 20 and all(r.n == 500 and 350 < r.a < 450 for r in rows)
    assert sum(r.a for r in rows) == 8000 and len({r.a for r in rows}) > 3


def test_slots_are_never_broadcast(corpus):
    taken = mixing.mixture(corpus[1], block=16, shard_blocks=32).taken
    slots = {(r.shard, r.slot) for r in taken.collect()}
    ran = taken._jdf.queryExecution().executedPlan().toString()  # as adaptive execution left it
    final = ran.split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in final
    joins = re.findall(r"(\w+Join)\b.*\[src#\d+L, block#\d+L\]", final)
    assert joins == ["SortMergeJoin"] and len(slots) > 32


def test_odd_rows(odd, nothing):
    made = mixing.mixture(odd, block=4)
    assert [s.name for s in made.sources] == ["a", "b", None]
    assert made.rows.count() == 9
    taken = {r.doc_id for r in made.taken.collect()}
    assert not taken & {1, 2, 3}
    out = mixing.mixed_documents(odd, block=4)
    assert out.columns == odd.columns and out.filter(F.col("text") == "").isEmpty()
    assert mixing.mixture(nothing).rows.isEmpty() and mixing.mixed_documents(nothing).isEmpty()


def test_passages_of_odd_rows_and_of_columns_named_like_helpers(odd, nothing):
    names = ("_mix_text", "_MIX_doc", "_mix_ranges", "_mix_all")
    docs = odd.withColumns({name: F.lit(7) for name in names})
    got = mixing.mixed_passages(docs).collect()
    texts = {r.text for r in docs.collect()}
    assert got and all(any(r.text in (t or "") for t in texts) and all(r[n] == 7 for n in names) for r in got)
    assert mixing.mixed_passages(nothing).isEmpty()
