"""The entry points without the corpus package, or with one that can't be imported."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("left", ["nothing", "an empty folder", "a broken module"])
def test_other_queries_stay_registered(tmp_path, left):
    skipped = shutil.ignore_patterns("__pycache__", "llm")
    shutil.copytree(os.path.join(ROOT, "basketry"), tmp_path / "basketry", ignore=skipped)
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    if left != "nothing":
        (tmp_path / "basketry" / "llm").mkdir()
        (tmp_path / "corpus_pipeline.py").write_text("from basketry.llm import queries\n")
    if left == "a broken module":
        (tmp_path / "basketry" / "llm" / "__init__.py").write_text("")
        (tmp_path / "basketry" / "llm" / "queries.py").write_text("import a_package_that_is_missing\n")
    code = "import __spark_entry__ as e; q = e.queries(); assert set(q) == set(e.oracle_sql()); print(len(q))"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert int(run.stdout) > 80
