"""The entry points stand without the optional training-data part."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]
NAMES = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*sorted(q))"


def names(folder: Path) -> list[str]:
    return subprocess.run([sys.executable, "-B", "-c", NAMES], cwd=folder, capture_output=True, text=True, check=True).stdout.split()


def test_without_the_optional_part(tmp_path: Path) -> None:
    shutil.copytree(REPO / "echolens", tmp_path / "echolens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    rest = names(tmp_path)
    assert "decisions_end_to_end" in rest
    assert not [n for n in rest if n.startswith("op") or n == "pipeline"]


def test_every_query_is_listed_once() -> None:
    found = names(REPO)
    assert len(found) == len(set(found))
