from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_names():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(oracles) > 80


def test_imports_without_the_operators(tmp_path):
    """Everything but the training-data operators works where these are absent."""
    import shutil

    shutil.copytree(ROOT / "quillon", tmp_path / "quillon", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert not any(n.startswith('op1') or n == 'pipeline' for n in q); assert 'like_post' in q and len(e.oracle_sql()) > 80"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_a_query_and_its_schema(spark):
    sf = Path("/root/testdata/sf0.001")
    if not sf.exists():
        return
    rows = entry.queries()["outputs_join_inner"](spark, str(sf))
    assert rows.columns == ["doc_id", "source", "_outputs__upper__0001"] and rows.count() > 0
