from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_names_and_oracles():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 49


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_the_text_operators(tmp_path):
    for name in ("__spark_entry__.py", "roadledger"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "roadledger" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 49 and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_them():
    for path in (ROOT / "roadledger").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "roadledger.llm" not in path.read_text(), path
