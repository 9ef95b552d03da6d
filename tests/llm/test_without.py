"""The rest of the repository stands without this subpackage."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]


def test_entry_without_llm(tmp_path):
    top = tmp_path / "repo"
    shutil.copytree(ROOT, top, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse", ".pytest_cache"))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op1_') for k in e.queries()), len(e.oracle_sql()))"], cwd=top, capture_output=True, text=True, check=True)
    n, has, m = out.stdout.split()
    assert int(n) > 100 and has == "False" and int(m) > 100


def test_nothing_imports_llm():
    for p in (ROOT / "gridloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text(encoding="utf-8")), p
