"""Every registered query against its SQL, on the small tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from thresher.plans.registry import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def _plain(x):
    return round(float(x), 6) if hasattr(x, "as_tuple") or (isinstance(x, float)) else x


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    found = QUERIES[name](spark, str(DATA))
    got = _rows(found.columns, found.collect())
    if name not in ORACLE_SQL:
        assert len(set(found.columns)) == len(found.columns)
        return
    cursor = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    assert got == _rows(columns, cursor.fetchall())


def test_entry_without_corpus_operators(tmp_path):
    """A copy without the corpus operators and their pipeline imports, and has all other queries and their SQL."""
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "thresher", tmp_path / "thresher", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    told = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.registry.QUERIES), sorted(e.oracle_sql()) == sorted(e.registry.ORACLE_SQL), e.corpus)"
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    found = subprocess.run([sys.executable, "-B", "-c", told], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=120, check=True)
    assert found.stdout.split() == ["True", "True", "None"]
