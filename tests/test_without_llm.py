"""The engine needs neither the training-data subpackage nor the pipeline."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_imports_without_them(tmp_path):
    to = tmp_path / "repo"
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'from_star' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=to, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_it():
    for p in (ROOT / "sluice").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"import.*\bllm\b|from.*\bllm\b", p.read_text()), p
