"""Every registered query with SQL gives, on the smallest tables, the rows that DuckDB gives."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry
from quire.plans.catalogue import ORACLE, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def shown(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return [shown(x) for x in value] if isinstance(value, list | tuple) else repr(value)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    ours = sorted(repr([shown(r[c]) for c in columns]) for r in df.collect())
    if name not in ORACLE:
        return
    found = duck.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert ours == sorted(repr([shown(r[i]) for i in at]) for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
