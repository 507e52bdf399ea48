"""The entry point works without the training-data part, or without what that part needs."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
LEAVE = shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "*.json", "*.md")


@pytest.mark.parametrize("gone", [["actispark/llm", "tests/llm", "corpus_pipeline.py"], ["actispark/llm", "tests/llm"], ["actispark/llm/queries.py"]])
def test_entry_without_training_data_part(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=LEAVE)
    for g in map(copy.joinpath, gone):
        shutil.rmtree(g) if g.is_dir() else g.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 90 and set(o) <= set(q) and not [k for k in q if k.startswith('op')]; print(len(q))"
    said = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}, timeout=120)
    assert said.returncode == 0, said.stderr
