"""Every registered query against its SQL; the entry point without the subpackage that may be deleted."""

import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from questmill import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def plain(v):
    if pd.isna(v):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return str(v)
    return f"{v:.9g}"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, small, con, name):
    got = registry.QUERIES[name](spark, small)
    if name not in registry.ORACLES:
        assert got.count() > 0
        return
    want = con.sql(registry.ORACLES[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    rows = lambda frame: sorted((tuple(map(plain, r)) for r in frame[columns].astype(object).values.tolist()), key=str)
    a, b = rows(got.toPandas()), rows(want.df())
    assert a == b  # a null is no empty text


def test_entry_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "r")})
