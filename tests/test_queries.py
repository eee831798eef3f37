"""Every registered query with SQL against DuckDB, and the others for rows, at the smallest scale."""

import os

import duckdb
import pytest

from tidemark.plans import registry

from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda v: "\x00" if v is None else f"{v:.5g}" if isinstance(v, float) else str(v)
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: list(map(key, r)))


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cur = duck.execute(registry.ORACLE[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    got, want = table(map(tuple, df.collect()), df.columns), table(cur.fetchall(), columns)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == b or all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1e-5 * max(1, abs(x))) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
