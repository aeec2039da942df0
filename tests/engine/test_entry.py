"""The driver's entry points without a session, and without the corpus operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SAY = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), len(o))"


def test_registry_needs_no_session(tmp_path):
    assert subprocess.run([sys.executable, "-c", SAY], cwd=ROOT, capture_output=True, check=True).stdout
    shutil.copytree(os.path.join(ROOT, "barloom"), tmp_path / "barloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    n, m = map(int, subprocess.run([sys.executable, "-c", SAY], cwd=tmp_path, capture_output=True, check=True).stdout.split())
    assert n > 80 and m > 70


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns == ["combination", "mask_hits", "trades", "total_return", "win_rate"]
