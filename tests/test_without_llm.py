"""The library, its entry and its other queries without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
GONE = ["pulsegrid/llm", "tests/llm", "corpus_pipeline.py"]


@pytest.mark.parametrize("gone", [GONE, GONE[:2], GONE[2:]])
def test_entry_imports(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        path = tmp_path / "r" / name
        shutil.rmtree(path, ignore_errors=True) if path.is_dir() else path.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql()); import tests.test_queries"
    run = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "r", env=os.environ | {"PYTHONPATH": str(tmp_path / "r")}, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr
    names = run.stdout.split()
    assert "history_snapshot" in names and "pipeline" not in names
    assert any(n.startswith("op") for n in names) == ("pulsegrid/llm" not in gone)
