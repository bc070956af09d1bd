import importlib.util
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
import pytest
from oracle import check

from scorelake.plans.catalogue import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, name):
    if name in ORACLES:
        check(QUERIES[name], ORACLES[name], spark, DIR)
    else:
        assert QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 6
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_plans(spark):
    """Filters and columns reach the scans, and each scorer has one shuffle of partial sums."""
    plan = lambda f: f._jdf.queryExecution().executedPlan().toString()
    text = plan(QUERIES["a23_mc_options"](spark, DIR))
    assert text.count("Exchange") == 1 and "p_retailprice" not in text
    text = plan(QUERIES["a10_tal"](spark, DIR))
    assert text.count("Exchange") == 1 and "ArrowEvalPython" not in text
    text = plan(QUERIES["n2_event_lists"](spark, DIR))
    assert "PushedFilters: [IsNotNull(role), Not(EqualTo(role,system))]" in text


def test_works_without_the_corpus_package(tmp_path):
    """With the corpus folders gone, everything else imports and the other queries are there."""
    import shutil

    shutil.copytree(ROOT / "scorelake", tmp_path / "scorelake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True).stdout.split()
    assert out[0] == str(len(QUERIES)) and out[1] == "False"
    for p in (ROOT / "scorelake").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
    assert importlib.util.find_spec("scorelake")
