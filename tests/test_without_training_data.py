"""The library is whole without its training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
PROBE = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), sorted(k for k in q if k.startswith('op') or k == 'pipeline'), set(o) <= set(q))"


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_queries_without_the_subpackage(tmp_path, with_pipeline):
    from docweave.plans.catalog import QUERIES

    shutil.copytree(REPO / "docweave", tmp_path / "docweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py")[: 1 + with_pipeline]:
        shutil.copy(REPO / name, tmp_path)
    done = subprocess.run([sys.executable, "-c", PROBE], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}, timeout=120)
    assert done.returncode == 0, done.stderr
    assert done.stdout.strip() == f"{len(QUERIES)} [] True"
