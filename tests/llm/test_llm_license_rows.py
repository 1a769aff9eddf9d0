"""The rows of op3_license_notices against plain Python over the whole given table."""

import os
import re

from basketry.llm import licenses

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = [(["cc", "by"], "cc-by"), (["general", "public", "license"], "gpl"), (["all", "rights", "reserved"], "reserved")]


def places(words):
    found = [(i, label) for phrase, label in BASE for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
    return [i for i, _ in found], {label for _, label in found}


def check(rows, docs):
    texts = {}
    for d in docs.collect():
        texts.setdefault(d.doc_id, []).append(d.text)
    assert len(rows) == sum(map(len, texts.values()))
    for r in rows:
        words = WORD.findall((texts[r.doc_id][0] or "").translate({c: c + 32 for c in range(65, 91)}))
        starts, labels = places(words)
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(starts), ",".join(sorted(labels)))
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if starts else (None, None))
        named = [x for x in r.labels.split(",") if x]
        assert named == sorted(set(named)) and labels <= set(named) and 0 <= r.score <= 1
        assert r.score == 1 if starts else True
    return sum(r.n_base for r in rows)


def test_query_equals_plain_python(spark):
    rows = licenses.op3_license_notices(spark, ROOT).collect()
    assert check(rows, spark.read.parquet(f"{ROOT}/documents.parquet")) > 0


def test_query_on_odd_and_empty_tables(spark, odd, nothing, documents, tmp_path):
    more = documents([(20, "CC BY cc, by GENERAL public license all rights-reserved ALL RIGHTS RESERVED"), (21, "general public " * 3000 + "license")], clashing=True)
    for name, docs in (("odd", odd.union(more)), ("empty", nothing)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        found = check(licenses.op3_license_notices(spark, str(tmp_path / name)).collect(), docs)
        assert found == (6 if name == "odd" else 0)
