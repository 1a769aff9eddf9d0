import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from basketry.llm import packing

TEXTS = [
    "", None, " a b", "a  b", "a\n b\t", "x<|endoftext|> y<|startoftext|>z", " ", "it's o'clock 12 3,4 --  x", "\x1c a\x1db \x1f", "A\xa0B　c \x85 d",
    "Ünïcödé WÖRDS, ñandú.", "日本 語。 a", "é ́a ́", "ΑΣ ΑΣ. σ", "İI i", "x" * 300 + " " + "y!" * 100, "😀 😀", "nul \x00 x",
]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(packing.default_tokenizer())


def whole_ids(plain, text):
    return [*plain.encode(text or "", add_special_tokens=False).ids, 1]


def naive_best_fit(sizes, capacity):
    """The fullest bin that takes the item, by looking at all bins."""
    bins = []
    for size in sizes:
        fits = [b for b in range(len(bins)) if bins[b] + size <= capacity]
        if fits:
            bins[max(fits, key=lambda b: bins[b])] += size
        else:
            bins.append(size)
    return sorted(bins)


def check(rows, capacity):
    """Sequences without gaps or overlaps, within the capacity; their number."""
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts]).tolist()][:-1]
        assert sum(n for _, n in parts) <= capacity
    return len(held)


def test_encoder_equals_the_tokenizer(plain, monkeypatch):
    rng = np.random.default_rng(1)
    pieces = ["a", "B", "The", " ", " ", "!?", "<|startoftext|>", "%", "#a", "\n", ".", ",", "'s", "'", "1", "é", "İ", "中", "̈", "​", "\xa0", "#", "_", "\x1c", "<|endoftext|>", " "]
    texts = TEXTS + ["".join(rng.choice(pieces, rng.integers(0, 20))) for _ in range(2000)]
    want = [whole_ids(plain, t)[:-1] for t in texts]
    encoder = packing.WordEncoder(packing.default_tokenizer())
    monkeypatch.setattr(packing, "_TOGETHER", 5)

    def encoded(some):
        ids, counts = encoder.encode(some)
        return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]

    assert encoded(texts) == want and encoded(texts) == want
    monkeypatch.setattr(packing, "_ROOM", 3)
    assert [encoded([t])[0] for t in texts] == want
    assert encoder.encode([None, ""])[1].tolist() == [0, 0]


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        packing.WordEncoder(str(public_tokenizers.path("byte_bpe_50k.json")))


def test_best_fit_equals_the_naive_one():
    rng = np.random.default_rng(2)
    for _ in range(100):
        sizes = np.sort(rng.integers(1, 65, int(rng.integers(0, 80))))[::-1]
        bins, offsets, used = packing.best_fit(sizes, 64)
        assert sorted(used.tolist()) == naive_best_fit(sizes.tolist(), 64)
        for b in range(len(used)):
            mine = np.flatnonzero(bins == b)
            assert offsets[mine].tolist() == (np.cumsum(sizes[mine]) - sizes[mine]).tolist()
    with pytest.raises(ValueError):
        packing.best_fit(np.array([65]), 64)
    with pytest.raises(ValueError):
        packing.best_fit(np.array([0]), 64)


@pytest.mark.parametrize("kind", ["any", "large", "small", "halves", "one size"])
def test_tree_packs_as_well_as_one_task(spark, kind):
    rng = np.random.default_rng(3)
    sizes = {
        "any": rng.integers(1, 101, 3000), "large": rng.integers(51, 90, 1500), "small": rng.integers(1, 8, 4000),
        "halves": rng.choice([50, 51, 49], 1500), "one size": np.full(1000, 34),
    }[kind].tolist()
    df = spark.createDataFrame(list(enumerate(sizes)), "row long, length long")
    places = packing.packed(df, 100, each=100, fan=3, slack=2)
    rows = places.join(df, "row").collect()
    assert sorted(r.row for r in rows) == list(range(len(sizes)))
    n = check(rows, 100)
    alone = len(naive_best_fit(sorted(sizes, reverse=True), 100))
    assert n <= alone * 1.04 + 1  # 10 to 41 partitions of 100 pieces each
    again = packing.packed(df.repartition(7), 100, each=100, fan=3, slack=2)
    assert again.exceptAll(places).isEmpty()


def test_small_bins_find_larger_ones_of_other_partitions(spark):
    """Each partition is left with one small bin; together with the large ones they fill up."""
    import pandas as pd

    group = pd.DataFrame({"node": 0, "bin": range(8), "used": [90, 85, 80, 75, 10, 15, 20, 25]})
    out = packing._merge(100, 2, 1)(group)
    assert len(out) == 4 and set(out["into"]) == {0, 1, 2, 3} and set(out["at"]) == {90, 85, 80, 75}
    bins = pd.DataFrame({"bin": range(6), "used": [99, 60, 70, 80, 30, 98]})
    assert packing.underfull(bins, 100, 2, 2)["bin"].tolist() == [4, 1, 2]


def test_pieces_and_sequences_hold_the_ids(documents, plain, monkeypatch):
    monkeypatch.setattr(packing, "_PIECES", 3)
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(150)] + [(500, "one two three " * 40), (None, "no id"), (3, "twice"), (3, "twice")]
    pieces, places = packing.packed_documents(documents(rows, clashing=True).repartition(5), packing.default_tokenizer(), 50, each=40)
    ids = {i: whole_ids(plain, t) for i, t in rows}
    got = pieces.join(places, "row").collect()
    n = check(got, 50)
    assert n <= sum(r.length for r in got) / 50 * 1.05 + 2
    by_doc = {}
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.doc_id][r.start : r.start + r.length] or r.doc_id == 3
        assert r.start == 50 * r.piece
        by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + r.length
    assert all(by_doc[i] == len(ids[i]) for i in ids if i != 3) and len(got) == len({r.row for r in got})
    where = {(r.sequence_id, r.offset): r for r in got}
    made = packing.sequences(pieces, places).collect()
    assert len(made) == n
    for s in made:
        parts = [where[s.sequence_id, o] for o in s.starts]
        assert bytes(s.ids) == b"".join(bytes(p.ids) for p in parts) and [p.doc_id for p in parts] == s.doc_ids


def test_query_equals_the_tokenizer(spark, tiny, plain):
    got = packing.op11_packed_sequences(spark, tiny).collect()
    docs = {r.doc_id: whole_ids(plain, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    assert sum(r.length for r in got) == sum(map(len, docs.values()))
    for r in got:
        ids = docs[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length == min(4096, len(docs[r.doc_id]) - r.start) and r.start == 4096 * r.piece
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    total = sum(r.length for r in got)
    assert check(got, 4096) <= -(-total // 4096) + 2


def test_odd_rows(odd, nothing):
    pieces, places = packing.packed_documents(odd, packing.default_tokenizer())
    got = pieces.join(places, "row").collect()
    assert sorted(r.length for r in got if r.doc_id in (1, 2, 3)) == [1, 1, 1]
    assert sum(1 for r in got if r.doc_id == 6) == 2 and sum(1 for r in got if r.doc_id is None) == 1
    assert sum(1 for r in got if r.length == 4096) == len([r for r in got if r.doc_id == 5]) - 1
    check(got, 4096)
    pieces, places = packing.packed_documents(nothing, packing.default_tokenizer())
    assert pieces.isEmpty() and places.isEmpty() and packing.sequences(pieces, places).isEmpty()
    none = odd.filter(F.col("doc_id") < 0)
    assert packing.packed_documents(none, packing.default_tokenizer())[1].isEmpty()
