import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from basketry.llm import queries, tokens
from basketry.llm.shared import stage
from compare import database, difference
from test_llm_minhash import brute


@pytest.fixture(scope="module")
def steps(spark, tiny):
    """The input of every stage and the last result."""
    docs, found = spark.read.parquet(f"{tiny}/documents.parquet"), []
    for _, function in corpus_pipeline.STAGES:
        found.append(docs)
        docs = stage(function(spark, docs, tiny))
    return [*found, docs]


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "text").collect()), key=str)


def test_stages_return_documents(steps):
    assert all(df.columns == steps[0].columns for df in steps[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "near-duplicates", "benchmark decontamination", "source mixture", "token files",
    ]


def test_quality_keeps_good_and_drops_bad(steps, spark, tiny):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{tiny}/labels.parquet").collect()}
    kept = {i for i, _ in rows(steps[1])}
    assert {i for i, q in labels.items() if q == 1} <= kept and not {i for i, q in labels.items() if q == 0} & kept


def test_one_document_of_each_component_stays(steps):
    components = {c for _, _, c in brute(rows(steps[1]), 5)}
    assert {i for i, _ in rows(steps[2])} == components


def test_contaminated_documents_go(steps, spark, tiny):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))

    windows = set()
    for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {" " + " ".join(w[i : i + 10]) + " " for i in range(max(1, len(w) - 9))}
    clean = [(i, t) for i, t in rows(steps[2]) if not any(x in " " + " ".join(words(t)) + " " for x in windows)]
    assert rows(steps[3]) == clean and len(clean) < steps[2].count()


def test_mixture_is_made_of_its_input(steps):
    texts = dict(rows(steps[3]))
    uses = {}
    for i, text in rows(steps[4]):
        assert text and set(text.split()) <= set(texts[i].split())
        uses[i] = uses.get(i, 0) + len(text.split())
    assert all(n <= 3 * len(texts[i].split()) for i, n in uses.items())


def test_token_files_hold_the_mixture(steps):
    plain = Tokenizer.from_file(str(tokens.default_tokenizer()))
    want, start = [], 0
    for i, text in sorted((r.doc_id, r.text) for r in steps[4].collect()):
        ids = plain.encode(text, add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, steps[5].select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


@pytest.mark.parametrize("key", list(queries.QUERIES))
def test_queries_run_over_whole_tables(spark, tiny, key):
    df = queries.QUERIES[key](spark, tiny)
    assert df.select("doc_id").distinct().count() == spark.read.parquet(f"{tiny}/documents.parquet").count()
    if key in queries.ORACLES:
        assert difference(queries.QUERIES[key](spark, tiny), database(tiny), queries.ORACLES[key]) is None
