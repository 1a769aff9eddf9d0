import hashlib
import random

import pytest

from basketry.llm import substrings


def brute(rows, size):
    places = {}
    lists = [(doc, (text or "").split()) for doc, text, *_ in rows]
    for k, (_, words) in enumerate(lists):
        for i in range(len(words) - size + 1):
            places.setdefault(tuple(words[i : i + size]), []).append((k, i))
    covered = [set() for _ in lists]
    for found in places.values():
        if len(found) > 1:
            for k, i in found:
                covered[k] |= set(range(i, i + size))
    return sorted(
        (
            (doc, len(words), len(c), hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in c).encode()).hexdigest())
            for (doc, words), c in zip(lists, covered, strict=True)
        ),
        key=str,
    )


def corpus(seed):
    """Random words with passages of many lengths set into several documents, some with an edit."""
    rng = random.Random(seed)
    passages = [[f"p{k}w{i}" for i in range(rng.choice([9, 10, 11, 15, 40]))] for k in range(12)]
    rows = []
    for doc in range(120):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += [rng.choice("abcdefgh") + str(rng.randint(0, 30)) for _ in range(rng.randint(0, 30))]
            if rng.random() < 0.5:
                passage = list(rng.choice(passages))
                if rng.random() < 0.4:
                    passage[rng.randrange(len(passage))] = "edit" + str(rng.randint(0, 3))
                words += passage
        if rng.random() < 0.1:
            words += ["x"] * rng.randint(0, 30)
        rows.append((doc, " ".join(words)))
    return rows + rows[:6]


@pytest.mark.parametrize("seed", [1, 2])
def test_removed_words_equal_brute_force(documents, seed):
    rows = corpus(seed)
    got = substrings.repeated_passages(documents(rows), window=10).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute(rows, 10)
    assert all(r.n_removed == sum(b - a for a, b in r.removed) for r in got)
    for r in got:
        assert all(any(a <= first and first + n <= b for a, b in r.removed) for first, n, _ in r.factors)


def test_runs_and_blocks_depend_on_words_alone():
    words = [str(i % 17).encode() for i in range(200)]
    alone = substrings.blocks_of([words], 20, 4)
    among = substrings.blocks_of([[b"q"] * 7, words, []], 20, 4)
    mine = among.row == 1
    assert (alone.seed == among.seed[mine]).all() and (alone.content == among.content[mine]).all()
    assert int(alone.count.sum()) == 181 and alone.first[0] == 0
    assert len(substrings.blocks_of([], 20, 4).row) == len(substrings.blocks_of([[b"a"]], 20, 4).row) == 0


def test_factors_join_neighbouring_blocks():
    marks = [{"first": f, "count": c, "same": s, "reference": r} for f, c, s, r in [(0, 3, True, 1), (3, 2, True, 1), (5, 4, False, 1), (9, 1, True, 2)]]
    assert substrings.factors_of(marks, 10) == [[0, 14, 1], [9, 10, 2]]
    assert substrings.removed_spans([[0, 14, 1]], [5, 30], 10) == [[0, 15], [30, 40]]


def test_odd_rows(odd, nothing):
    got = substrings.repeated_passages(odd, window=10).collect()
    assert len(got) == 9
    removed = sorted((r.doc_id, r.n_removed) for r in got if r.n_removed and r.doc_id != 5)
    assert removed == [(6, 10), (6, 10), (7, 10)]
    long = next(r for r in got if r.doc_id == 5)
    assert (long.n_words, long.n_removed) == (20_000, 20_000)
    assert substrings.repeated_passages(nothing).isEmpty()
