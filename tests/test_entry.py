"""The entry module without the optional subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_imports_without_the_subpackage(tmp_path):
    copy = tmp_path / "repo"
    left_out = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "*.json")
    shutil.copytree(REPO, copy, ignore=left_out)
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True)
    names, with_sql = (set(line.split()) for line in done.stdout.splitlines())
    assert "search_personalised" in names and "pipeline" not in names
    assert not [n for n in names if n.startswith("op") and n[2].isdigit()] and with_sql <= names
