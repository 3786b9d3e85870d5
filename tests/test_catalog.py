"""Every query of the registry against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from decidra.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: repr(round(v, 9) + 0.0) if isinstance(v, float) else repr(v)
    return sorted(columns), sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name in SQL:
        want = duck.sql(SQL[name])
        assert normal(rows, df.columns) == normal(want.fetchall(), want.columns)


def test_entry_without_llm(monkeypatch):
    """With the subpackage there its queries come too; with its import blocked the engine's own are left, and nothing fails."""
    import importlib
    import sys

    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    with monkeypatch.context() as patch:
        for name in [m for m in sys.modules if m == "decidra.llm" or m.startswith("decidra.llm.")]:
            patch.delitem(sys.modules, name)
        patch.setitem(sys.modules, "decidra.llm", None)
        bare = importlib.reload(entry)
        assert bare.queries() == QUERIES and bare.oracle_sql() == SQL
    importlib.reload(entry)
