"""The rows of op2_source_mixture against plain Python over the whole given table."""

import os
import re
from collections import Counter

import pytest

from basketry.llm import mixing

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    """Shares by weights 5, 2, 1; whoever passes three times its size stops there, until nobody does."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        left = total - sum(stopped.values())
        open_weight = sum(w for s, w in weight.items() if s not in stopped)
        share = {s: left * w / open_weight for s, w in weight.items() if s not in stopped}
        over = {s: 3 * sizes[s] for s, x in share.items() if x > 3 * sizes[s]}
        if not over:
            return {**stopped, **share}
        stopped.update(over)


def check(rows, docs):
    wanted = sorted((str(d.doc_id), str(d.source), len(WORD.findall(d.text or ""))) for d in docs.collect())
    assert sorted((str(r.doc_id), str(r.source), r["size"]) for r in rows) == wanted
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    targets = plain_targets(sizes) if rows else {}
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 2 * mixing.BLOCK


def test_query_equals_plain_python_and_a_rerun(spark):
    first = mixing.op2_source_mixture(spark, ROOT).collect()
    check(first, spark.read.parquet(f"{ROOT}/documents.parquet"))
    again = mixing.op2_source_mixture(spark, ROOT).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))


@pytest.mark.parametrize("case", ["odd", "empty"])
def test_query_on_odd_and_empty_tables(spark, odd, nothing, tmp_path, case):
    docs = odd if case == "odd" else nothing
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    check(mixing.op2_source_mixture(spark, str(tmp_path)).collect(), docs)
