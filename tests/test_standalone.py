"""The library without its optional subpackage."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_core_never_imports_the_training_data_subpackage():
    for path in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "tessera.llm" not in path.read_text(), path


def test_entry_works_without_it(tmp_path):
    import shutil

    shutil.copytree(ROOT / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op1_') for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    n, m, any_op = out.stdout.split()
    assert int(n) >= int(m) > 100 and any_op == "False"
