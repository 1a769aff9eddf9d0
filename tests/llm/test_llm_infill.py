import hashlib
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basketry.llm import infill
from basketry.llm.shared import portions

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def expected(doc_id, text, rate=50, spm=80):
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc_id, n, "plain", None, None, text)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if h[3] % 100 < spm:
        return (doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


TEXTS = [
    "", None, " ", "word", " two words \n", "\t\n\x0b\x0c\r x", "日本 語。 é　ü", "a<P>b c", "ends with <", "<S <M< P> >", "nul \x00 and \x1e here",
    "<M>", "\xa0 no blank", "x " * 500, "😀 😀 " * 50, "P> S> M> <P <S <M",
]


@pytest.mark.parametrize("rate", [50, 100])
def test_equals_brute_force_and_restores(documents, rate):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(400)] + [(None, "no id"), (7, "again"), (7, "again")]
    made = infill.fill_in_middle(documents(rows, clashing=True).repartition(5), rate=rate)
    got = made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    want = [expected(i, t, rate) for i, t in rows]
    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(map(str, want))
    texts = {(i, t or "") for i, t in rows}
    assert all((r.doc_id, r.back) in texts for r in got)
    assert {r.form for r in got} == {"plain", "spm", "psm"}


def test_odd_rows(odd, nothing, monkeypatch):
    monkeypatch.setattr(infill, "_BYTES", 40)
    want = sorted(str(expected(r.doc_id, r.text)) for r in odd.collect())
    assert sorted(str(tuple(r)) for r in infill.fill_in_middle(odd).collect()) == want
    assert infill.fill_in_middle(nothing).collect() == []


def test_portions_hold_all_rows():
    texts = ["x" * 30, None, "", "abc", "defghij", "k", "l" * 11, "m"]
    got = list(portions(pa.RecordBatch.from_pydict({"text": texts}), 10))
    assert [t for p in got for t in p.column("text").to_pylist()] == texts and len(got) == 5
    assert list(portions(pa.RecordBatch.from_pydict({"text": pa.array([], pa.string())}), 10)) == []


def test_texts_are_not_shuffled(spark, tiny):
    plan = infill.op13_fill_in_middle(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan
