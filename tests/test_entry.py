"""The entry point with and without the optional folder."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; print(*e.queries(), sep='\\n')"


@pytest.mark.parametrize("gone", [("reviewlake/llm", "tests/llm"),
                                  ("reviewlake/llm", "tests/llm", "corpus_pipeline.py")])
def test_import_without_the_optional_folder(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=lambda folder, names: [
        n for n in names if n in (".git", "__pycache__")
        or str((Path(folder) / n).relative_to(ROOT)) in gone])
    run = subprocess.run([sys.executable, "-c", SHOW], cwd=copy, capture_output=True, text=True,
                         env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
    assert run.returncode == 0, run.stderr
    names = run.stdout.split()
    assert "scan_health" in names and "pipeline" not in names
    assert not [n for n in names if n.startswith("op")]
