from __future__ import annotations

import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from tests.conftest import ROOT, SF, duck_rows, rows_of

OWN = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


#: Queries without SQL, with the tests that hold them against brute force or cases worked out by hand.
BY_HAND = {"d12_chunks": "test_chunks", "d13_summaries": "test_summaries_equal_brute_force", "e12_readability": "test_readability_medians"}


@pytest.mark.parametrize("name", OWN)
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    if sql := entry.oracle_sql().get(name):
        assert rows_of(df) == duck_rows(duck, sql)
    else:
        assert BY_HAND[name] in "".join(f.read_text() for f in (ROOT / "tests").glob("test_*.py")) and df.count() > 0


def test_flagship_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["content_id", "overall", "confidence", "coverage", "band"]
    assert df.count() == 200


@pytest.mark.parametrize("also", [[], ["corpus_pipeline.py"]])
def test_imports_without_the_training_data_subpackage(tmp_path, also):
    """A whole copy of the repository without the two folders, and with or without the pipeline."""
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for gone in ["contentgauge/llm", "tests/llm"]:
        shutil.rmtree(tmp_path / "repo" / gone, ignore_errors=True)
    for gone in also:
        (tmp_path / "repo" / gone).unlink(missing_ok=True)
    code = "import __spark_entry__ as e; assert e.llm is None and len(e.queries()) > 10 and 'pipeline' not in e.queries() and not [q for q in e.queries() if q.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env={"PATH": "/usr/bin:/bin"})
