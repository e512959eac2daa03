"""The entry point loads its queries without a session."""

import subprocess
import sys
from pathlib import Path


def test_queries_load_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), len(o))"
    got = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr
    queries, oracles = map(int, got.stdout.split())
    assert queries > 240 and oracles > 200
