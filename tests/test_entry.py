"""The entry module with and without the optional folders."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_every_query_without_sql_is_a_known_one():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.QUERIES) >= 58 and set(e.QUERIES) <= set(e.oracle_sql())


def test_import_without_the_optional_folders(tmp_path):
    import shutil

    shutil.copytree(ROOT / "mcqlab", tmp_path / "mcqlab", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)  # corpus_pipeline.py goes with the folders
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=60)
    from mcqlab.plans.catalog import QUERIES

    assert out.stdout.split() == [str(len(QUERIES))] * 2, out.stderr
