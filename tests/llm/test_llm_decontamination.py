import random
import re

import pytest

from basketry.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def normal(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(rows, items, size):
    windows = {}
    for item, text in items:
        words = normal(text)
        for i in range(max(1, len(words) - size + 1) if words else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add(item)
    result = []
    for doc, text, *_ in rows:
        words = normal(text)
        hit, found = set(), set()
        for length in {len(w) for w in windows}:
            for i in range(len(words) - length + 1):
                holders = windows.get(tuple(words[i : i + length]))
                if holders is not None:
                    hit |= set(range(i, i + length))
                    found |= holders
        result.append((doc, len(words), len(hit), sorted(i for i in found if i is not None)))
    return sorted(result, key=str)


@pytest.fixture(scope="module")
def case(spark, documents):
    rng = random.Random(5)
    vocabulary = ["a", "B", "ç", "d1", "E"]
    items = [(i, ", ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 9)))) for i in range(25)]
    items += [(3, items[3][1]), (30, None), (31, "..."), (None, "a a a a a a")]
    rows = [(i, rng.choice(["; ", " ", "\n"]).join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(80)]
    return rows, items, documents(rows), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("limit", [10**6, 60])
def test_hits_equal_brute_force(case, limit):
    """Also with the windows cut into many groups."""
    rows, items, docs, benchmark = case
    got = decontamination.scan(docs, benchmark, window=6, automaton_bytes=limit).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=str) == brute(rows, items, 6)
    texts = dict(rows)
    for r in got:
        words = normal(texts[r.doc_id])
        assert r.n_hit == sum(b - a for a, b in r.runs)
        for (a, b), (start, end) in zip(r.runs, r.spans, strict=True):
            assert normal(texts[r.doc_id][start:end]) == words[a:b]


def test_parts_keep_every_window(spark):
    rows = [(f"w{i} x", item) for i in range(10) for item in range(3)]
    windows = spark.createDataFrame(rows, "window string, item long")
    parts = decontamination.grouped(windows, 12).collect()
    assert sorted(r.window for r in parts) == sorted({w for w, _ in rows}) and sorted(r.number for r in parts) == list(range(10))
    sizes = [sum(len(r.window) for r in parts if r.part == p) for p in {r.part for r in parts}]
    assert len(sizes) == 4 and max(sizes) <= 12 + 4
    assert decontamination.grouped(windows.limit(0), 12).isEmpty()


@pytest.mark.parametrize("limit", [10**6, 400])
def test_a_window_that_most_items_hold(spark, documents, limit):
    """Each document names all items, and the items of a window are rows, never one list for the driver."""
    benchmark = spark.createDataFrame([(i, f"the same start of it {'end' if i % 2 else f'x{i}'}") for i in range(60)], "item_id long, text string")
    docs = documents([(1, "so: The same start of it."), (2, "nothing here"), (3, "same start of it x4")])
    got = {r.doc_id: r for r in decontamination.scan(docs, benchmark, window=5, automaton_bytes=limit).collect()}
    assert got[1]["items"] == list(range(60)) and got[1].spans == [[4, 24]]
    assert got[2]["items"] == [] and got[3]["items"] == [4]  # the last five words of item 4
    assert decontamination.windows_of(benchmark, 5).filter("window = 'the same start of it'").count() == 60
    lean = decontamination.scan(docs, benchmark, window=5, automaton_bytes=limit, items=False)
    assert lean.columns == ["doc_id", "n_words", "n_hit", "runs", "spans"]
    assert {r.doc_id: r.n_hit for r in lean.collect()} == {1: 5, 2: 0, 3: 5}


@pytest.mark.parametrize("limit", [10**6, 20])
def test_clean_rows_keep_all_columns(odd, spark, limit):
    benchmark = spark.createDataFrame([(2, "word"), (1, "same text here for all of us to read now")], "item_id long, text string")
    rows = odd.withColumn("_row", odd.doc_id * 2).withColumn("found", odd.text).withColumn("runs", odd.doc_id).withColumn("items", odd.lang)
    left = decontamination.without_hits(rows, benchmark, automaton_bytes=limit)
    assert left.schema == rows.schema
    assert sorted(map(str, left.collect())) == sorted(str(r) for r in rows.collect() if r.doc_id not in (4, 6, 7))


def test_odd_rows(odd, nothing, spark):
    benchmark = spark.createDataFrame([(1, "same text here for all of us to read NOW"), (2, "word"), (3, None)], "item_id long, text string")
    got = decontamination.scan(odd, benchmark, carry=odd.columns)
    assert got.count() == 9 and {"text", "lang"} <= set(got.columns)
    by_id = {r.doc_id: r for r in got.collect()}
    assert (by_id[6].n_hit, by_id[6]["items"], by_id[4]["items"], by_id[1].n_words, by_id[5].n_hit) == (10, [1], [2], 0, 0)
    assert by_id[6].spans == [[0, len("same text here for all of us to read now")]]
    assert decontamination.scan(nothing, benchmark).isEmpty()
    assert decontamination.scan(odd, benchmark.limit(0)).filter("n_hit > 0").isEmpty()
