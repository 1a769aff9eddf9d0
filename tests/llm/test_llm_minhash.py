import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from basketry.llm import components, minhash


def shingles(text, k):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in (text or "").split()]
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def brute(rows, k, percent=80):
    sets = [shingles(t, k) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    return {(rows[i][0], len(sets[i]), min(groups[root(i)])) for i in range(len(rows))}


def near_copies(seed, n):
    """Random texts, exact copies, and chains of copies that drift from each other."""
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(400)]
    rows = []
    while len(rows) < n:
        text = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        rows.append(" ".join(text))
        for _ in range(rng.choice([0, 0, 1, 6])):
            for _ in range(rng.choice([0, 1, max(1, len(text) // 40)])):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((" " if rng.random() < 0.5 else "  ").join(text))
    order = list(range(len(rows)))
    rng.shuffle(order)
    return list(zip(order, rows, strict=True))


@pytest.mark.parametrize("k", [2, 5])
def test_components_equal_brute_force(documents, k):
    rows = near_copies(k, 260)
    got = minhash.near_duplicates(documents(rows), shingle=k).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows, k)
    assert len(got) == len(rows)
    firsts = [r for r in got if r.first]
    assert all(r.doc_id == r.component_id for r in firsts)
    assert len(firsts) == len({r.component_id for r in got})


def test_components_that_a_star_leaves_apart_are_joined(spark):
    """b and c are similar, a, with which both are candidates, to neither."""
    words = [f"w{i}" for i in range(100)]
    texts = {1: words, 2: ["x"] * 20 + words[20:], 3: ["x", "y"] * 10 + words[22:], 4: words[1:], 5: ["z"]}
    table = spark.createDataFrame([(n, " ".join(w)) for n, w in texts.items()], "node long, text string")
    clusters = spark.createDataFrame([(n, 1) for n in texts], "node long, label long")
    labels = spark.createDataFrame([(1, 1), (4, 1)], "node long, label long")
    want = {
        (max(i, j), min(i, j)) for i in texts for j in texts
        if i != j and not {i, j} <= {1, 4} and 10 * len(shingles(" ".join(texts[i]), 2) & shingles(" ".join(texts[j]), 2)) >= 8 * len(shingles(" ".join(texts[i]), 2) | shingles(" ".join(texts[j]), 2))
    }
    got = {tuple(r) for r in minhash._across(clusters, table, labels, 2, 80).collect()}
    assert got and got <= want and {tuple(sorted(p)) for p in got} == {(2, 3)}


def test_unlike_rows_that_head_the_shared_buckets_hide_no_link(documents):
    """Every bucket that a pair shares is headed by smaller rows like neither."""
    rng = random.Random(400)
    pool = [f"p{i}" for i in range(60)]
    heads = [" ".join([*rng.sample(pool, 20), *(f"h{k}x{i}" for i in range(36))]) for k in range(400)]
    pairs = [" ".join([*pool, *(f"q{k}{j}x{i}" for i in range(5))]) for k in range(5) for j in range(2)]
    rows = list(enumerate([*heads, *pairs]))
    got = minhash.near_duplicates(documents(rows), shingle=1, width=1, agree=12).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows, 1)


def test_blocks_link_as_pairs_do():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**60, 60, dtype=np.uint64)
    some = [{"node": k, "label": k, "set": np.unique(np.concatenate([rng.choice(base, 50, replace=False), rng.integers(0, 2**60, int(rng.integers(0, 12)), dtype=np.uint64)])).tobytes()} for k in range(40)]
    got = set(minhash.linked(some[:25], some[25:], 80))
    read = [np.frombuffer(e["set"], np.uint64) for e in some]
    assert got == {(j, i) for i in range(25) for j in range(25, 40) if minhash.similar(read[i], read[j], 80)}
    same = [{**e, "label": 1} for e in some]
    assert minhash.linked(same[:25], same[25:], 80) == []


def test_half_keys_agree_for_equal_sets_only():
    a, b = (np.unique(np.random.default_rng(s).integers(0, 2**63, 50, dtype=np.uint64)) for s in (1, 2))
    keys, sketch = minhash.half_keys([a, b, a], 2, 9)
    assert (keys[0] == keys[2]).all() and (sketch[0] == sketch[2]).all() and not (keys[0] == keys[1]).any()
    assert keys.shape == (3, 18) and sketch.shape == (3, 36)


def test_odd_rows(odd, nothing):
    got = sorted((minhash.near_duplicates(odd, 2).select("doc_id", "n_shingles", "component_id", "first").collect()), key=str)
    by_id = {r.doc_id: r for r in got if r.doc_id not in (6, None)}
    assert all(by_id[i].n_shingles == 0 and by_id[i].component_id == i and by_id[i].first for i in (1, 2, 3))
    assert by_id[4].n_shingles == 1 and by_id[5].component_id == 5 and by_id[7].component_id == 6
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert sum(r.first for r in got if r.component_id == 6) == 1 and len(got) == 9
    kept = minhash.deduplicated(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 3, 4, 5, 6, None]
    assert minhash.near_duplicates(nothing).isEmpty() and minhash.deduplicated(nothing).isEmpty()


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 140)] + [(5000, 139)]
    edges = spark.createDataFrame([*chain, *star, *star, (7, 7)], "u long, v long")
    got = {r.node: r.label for r in components.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys([*range(100, 140), 5000], 100)}


def test_columns_named_like_helpers_stay(documents):
    docs = documents([(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "")])
    docs = docs.withColumns({name: F.lit(7) for name in ("_near_doc", "_Near_Text")})
    got = minhash.deduplicated(docs).collect()
    assert sorted(r.doc_id for r in got) == [1, 3] and all(r["_near_doc"] == r["_Near_Text"] == 7 for r in got)
