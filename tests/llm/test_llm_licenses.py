import random

import pytest

from basketry.llm import licenses


@pytest.fixture(scope="module")
def machine():
    return licenses.automaton()


def test_matching_statistics_equal_brute_force(machine):
    rng = random.Random(3)
    sequences = machine.sequences
    parts = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    vocabulary = [*machine.vocabulary, b"zz"]
    for _ in range(150):
        words = []
        while len(words) < 30:
            if rng.random() < 0.6:
                s = rng.choice(sequences)
                i = rng.randrange(len(s))
                words += s[i : i + rng.randrange(1, 9)]
            else:
                words.append(rng.choice(vocabulary))
        want = {}
        for at in range(len(words)):
            longest = max(n for n in range(at + 2) if n == 0 or tuple(words[at - n + 1 : at + 1]) in parts)
            if longest > 1:
                want[at] = longest
        found = list(machine.matches(words))
        assert {at: n for at, n, _, _ in found} == want
        for at, n, state, ends in found:
            match = words[at - n + 1 : at + 1]
            places = [(k, e) for k, s in enumerate(sequences) for e in range(n - 1, len(s)) if s[e - n + 1 : e + 1] == match]
            assert machine.ends[state] == places
            assert ends == (want.get(at + 1, 0) <= n)
            phrases = sorted(p for p, _ in licenses.PHRASES if match[-len(p.split()) :] == p.encode().split())
            assert len([1 for size, _ in machine.phrases[state] if size <= n]) == len(phrases)


def test_chains_cover_templates_in_order():
    found = licenses.chains([(0, 4, [(0, 3)]), (5, 3, [(0, 7)]), (40, 3, [(0, 2), (1, 5)])], gap=3, templates=2)
    assert [(c.template, c.first, c.last, c.matched) for c in sorted(found, key=lambda c: (c.first, c.template))] == [
        (0, 0, 7, 7), (0, 40, 42, 3), (1, 40, 42, 3),
    ]


def test_documents(documents, odd, nothing):
    mit = licenses.TEMPLATES[11][1]
    cut = "Permission is hereby granted -- free of charge, to ANY person obtaining one copy of this software and associated documentation files."
    rows = [
        (1, "x All rights reserved. all RIGHTS-reserved"), (2, mit), (3, cut), (4, "Licensed under the Apache License, Version 2.0."),
        (5, "the license of any software and the files"), (6, "cc by cc by the GNU General Public License, version 2"),
    ]
    got = {r.doc_id: r for r in licenses.scan(documents(rows)).collect()}
    assert [p["first"] for p in got[1].places] == [1, 4] and not got[1].spans
    best = {i: max(((s.coverage, s.label) for s in got[i].spans), default=(0, "")) for i in got}
    assert best[2] == (1.0, "mit") and best[4] == (1.0, "apache-2.0") and best[5] == (0, "")
    assert best[3][1] == "mit" and 0.8 <= best[3][0] < 1
    assert [(p["label"], p["first"]) for p in got[6].places] == [("cc-by", 0), ("cc-by", 2), ("gpl", 6)]
    assert licenses.scan(odd).count() == 9 and licenses.scan(odd).filter("size(places) + size(spans) > 0").isEmpty()
    assert licenses.scan(nothing).isEmpty()
