from __future__ import annotations

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

ROOT = Path(__file__).parents[1]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    found = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(found)


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_without_the_llm_subpackage(tmp_path, gone):
    """The whole repository less both folders, with and without the pipeline: it imports, and tests of the rest run."""
    kept = tmp_path / "repo"
    shutil.copytree(ROOT, kept, ignore=shutil.ignore_patterns(*gone, ".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'search_top_k' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); e.oracle_sql(); import quireflow.cli, bench"
    rest = [p for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), *sys.path] if p and Path(p).resolve() != ROOT]
    env = os.environ | {"PYTHONPATH": os.pathsep.join([str(kept), *rest]), "PYTHONDONTWRITEBYTECODE": "1"}
    subprocess.run([sys.executable, "-c", code], cwd=kept, env=env, check=True, timeout=120)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "--collect-only", "tests"], cwd=kept, env=env, check=True, timeout=120)
    some = ["tests/test_operators.py::test_text_functions", "tests/test_operators.py::test_splitter", "tests/test_queries.py::test_oracle[doc_strip]"]
    subprocess.run([sys.executable, "-m", "pytest", "-q", *some], cwd=kept, env=env, check=True, timeout=300)


def test_nothing_else_imports_llm():
    for path in (ROOT / "quireflow").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"\bllm\b.*import|import.*\bllm\b", path.read_text()), path
