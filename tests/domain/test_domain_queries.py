"""Every registered query of the domain against its DuckDB twin at sf0.001, and the entry module without the corpus
operators."""

import decimal
import math
import os
import subprocess
import sys

import duckdb
import pytest

from dealspark.plans import composite, core, registry, retrieval, text  # noqa: F401


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float | decimal.Decimal):
        return repr(float(v) + 0.0)
    return str(list(v)) if isinstance(v, list | tuple) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"create view {name.split('.')[0]} as from '{sf}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=str)
    if name in registry.ORACLES:
        found = duck.sql(registry.ORACLES[name])
        assert sorted(found.columns) == cols
        assert rows == sorted((tuple(plain(v) for v in r) for r in found.select(*[f'"{c}"' for c in cols]).fetchall()), key=str)


def test_entry_without_corpus_operators(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run(["cp", "-r", f"{root}/dealspark", f"{root}/__spark_entry__.py", str(tmp_path)], check=True)
    subprocess.run(["rm", "-r", str(tmp_path / "dealspark/llm")], check=False)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and not any(q.startswith('op') for q in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
