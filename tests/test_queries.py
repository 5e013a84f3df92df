"""Every registered query that has SQL against DuckDB on the smallest test data."""

import importlib.util

import duckdb
import pytest
from conftest import DATA, ROOT


def load(name, path):
    spec = importlib.util.spec_from_file_location(name, path)
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


entry, compare = load("entry", ROOT / "__spark_entry__.py"), load("compare", ROOT / "tools" / "compare.py")
NAMES = [q for q in entry.queries() if q in entry.oracle_sql() and (q.startswith("q_") or q[:2] in ("p2", "p3", "p4", "p5"))]


@pytest.fixture(scope="module")
def con():
    if not DATA.exists():
        pytest.skip("no test data")
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    a, b = compare.norm(entry.queries()[name](spark, str(DATA)).toPandas()), compare.norm(con.sql(entry.oracle_sql()[name]).df())
    assert list(a.columns) == list(b.columns) and a.shape == b.shape and bool((a == b).all().all())


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0
