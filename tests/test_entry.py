"""The registry: whole without the corpus operators, and where one of their libraries is missing."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

from cueline.plans import catalog

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("blocked", ["cueline.llm", "ahocorasick", "corpus_pipeline"])
def test_imports_without(blocked):
    code = f"import sys; sys.modules[{blocked!r}] = None; import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    names, sql = (set(x.split()) for x in done.stdout.splitlines()[-2:])
    assert set(catalog.QUERIES) <= names and set(catalog.ORACLE_SQL) <= sql and sql <= names
    assert "pipeline" not in names


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)
