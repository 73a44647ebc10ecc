"""The entry works where the training-data operators have been taken away."""

import shutil
import subprocess
import sys
from pathlib import Path


def test_without_llm(tmp_path):
    root = Path(__file__).resolve().parent.parent
    for name in ("millrace", "__spark_entry__.py"):
        source = root / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; n = e.queries(); assert len(n) > 80 and not [k for k in n if k.startswith('op') or k == 'pipeline']; assert set(e.oracle_sql()) <= set(n)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, check=True)


def test_nothing_else_imports_llm():
    root = Path(__file__).resolve().parent.parent / "millrace"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "millrace.llm" not in path.read_text(), path
