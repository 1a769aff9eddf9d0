import io
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from basketry.llm import bitpack, tokens

TEXTS = [
    "", None, " a b", "a  b", "a\n b", "a \nb", "x<|endoftext|> y z", " ", "a b ", "it's o'clock 12 3,4 --  x", "tab\there now", "\n", "\na b\n",
    "a b\nc", "x  y", " \n", "a\n\nb", "x!! y, ,, !.. é. 5. a5. don't, it's. ß! (a). a*** #", "Ünïcödé wörds, ñandú.", "日本 語。 a", "a b",
]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(str(tokens.default_tokenizer()))


@pytest.mark.parametrize("room", [1, 10_000])
@pytest.mark.parametrize("end", [None, 0, 7])
def test_encoder_equals_the_tokenizer(plain, room, end):
    encoder = tokens.Encoder(str(tokens.default_tokenizer()), room, end)
    after = [] if end is None else [end]
    assert encoder.by_word
    for _ in range(2):
        for batch in (TEXTS[:7], TEXTS[7:], TEXTS):
            ids, counts = encoder.encode(batch)
            got = np.split(ids, np.cumsum(counts)[:-1])
            assert [g.tolist() for g in got] == [plain.encode(t or "", add_special_tokens=False).ids + after for t in batch]


def test_encoder_equals_the_tokenizer_on_random_texts(plain):
    pieces = ["a", "b", "The", " ", " ", "\n", ".", ",", "!", "'s", "'", "1", "é", "İ", "中", "\u0308", "\u200b", "\xa0", "#", "?", "_", "😀"]
    rng = np.random.default_rng(1)
    encoder = tokens.Encoder(str(tokens.default_tokenizer()), end_id=0)
    for _ in range(1000):
        texts = ["".join(rng.choice(pieces, rng.integers(0, 15))) for _ in range(4)]
        ids, counts = encoder.encode(texts)
        got = np.split(ids, np.cumsum(counts)[:-1])
        assert [g.tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids + [0] for t in texts]


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    encoder, other = tokens.Encoder(path), Tokenizer.from_file(path)
    ids, counts = encoder.encode(TEXTS)
    got = np.split(ids, np.cumsum(counts)[:-1])
    assert not encoder.by_word
    assert [g.tolist() for g in got] == [other.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


@pytest.mark.parametrize("width", [1, 5, 16, 17, 31, 32])
@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 4096, 9999])
def test_packing_round_trip(width, n):
    ids = np.random.default_rng(n).integers(0, 2**width, n, dtype=np.uint64).astype(np.uint32)
    packed = bitpack.pack(ids, width)
    assert len(packed) == -(-n * width // 64)
    assert (bitpack.unpack(packed, width, n) == ids).all()


def test_packing_rejects_large_ids():
    with pytest.raises(ValueError):
        bitpack.pack(np.array([8], np.uint32), 3)
    assert [bitpack.bits_for(n) for n in (1, 2, 3, 256, 257, 50_257)] == [1, 1, 2, 8, 9, 16]


def test_file_gives_random_access():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 1000, int(n), dtype=np.uint64).astype(np.uint32) for n in rng.integers(0, 300, 60)]
    out = io.BytesIO()
    writer = bitpack.PackedWriter(out, 10, block=128)
    for i in range(0, 60, 7):
        part = docs[i : i + 7]
        writer.append([None if k == 3 else k for k in range(i, i + len(part))], np.concatenate(part), np.array([len(d) for d in part]))
    writer.close()
    reader = bitpack.PackedReader(io.BytesIO(out.getvalue()))
    every = np.concatenate(docs)
    for start, stop in [(0, len(every)), (5, 6), (127, 129), (1000, 3000), (len(every) - 1, len(every) + 9), (7, 7)]:
        assert (reader.ids(start, stop) == every[start:stop]).all()
    read = [(doc, np.concatenate([np.empty(0, np.uint32), *pieces])) for doc, pieces in reader.documents(blocks=2)]
    assert [doc for doc, _ in read] == [None if k == 3 else k for k in range(60)]
    assert all((ids == want).all() for (_, ids), want in zip(read, docs, strict=True))
    with pytest.raises(ValueError):
        bitpack.PackedReader(io.BytesIO(b"x" * 100))


def test_files_hold_all_documents_in_order(documents, plain, tmp_path):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(200)][::-1]
    manifest = tokens.write_tokens(documents(rows).repartition(6), str(tokens.default_tokenizer()), str(tmp_path / "t"))
    got = sorted(map(tuple, tokens.read_tokens(manifest).collect()))
    start, want = 0, []
    for i, text in sorted(rows):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    shards = manifest.orderBy("shard").collect()
    assert sum(r.n_ids for r in shards) == start and sum(r.n_docs for r in shards) == 200
    with tokens.open_packed(str(tmp_path / "t"), shards[0].file) as source:
        assert bitpack.PackedReader(source).width == 16


def test_odd_rows(odd, nothing):
    got = tokens.read_tokens(tokens.write_tokens(odd, str(tokens.default_tokenizer()))).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 5, 6, 6, 7]
    assert got[1].n_tokens == got[2].n_tokens == 1 and got[6].ids_crc32 == got[7].ids_crc32
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(9)]
    assert tokens.read_tokens(tokens.write_tokens(nothing, str(tokens.default_tokenizer()))).isEmpty()


def test_rows_of_one_id_go_to_many_tasks(spark, documents, plain):
    """Rows without id, and rows of one id, are spread over files; the places still follow each other."""
    rows = [(None, f"text {i} {TEXTS[i % len(TEXTS)]}") for i in range(300)] + [(9, f"w{i}") for i in range(300)] + [(4, "a")]
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = tokens.write_tokens(documents(rows), str(tokens.default_tokenizer()))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    files = [r.n_docs for r in manifest.collect()]
    assert sum(files) == 601 and len(files) >= 4 and max(files) < 200
    got = sorted(tokens.read_tokens(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 300 + [4] + [9] * 300
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(601)]
    want = sorted((str(d), zlib.crc32(np.array(plain.encode(t, add_special_tokens=False).ids + [0], "<u4").tobytes())) for d, t in rows)
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == want
