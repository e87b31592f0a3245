"""Every query of the engine against its DuckDB counterpart on the smallest tables."""

import os

import pytest

from plumbline import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def value(v):
    return round(v, 9) + 0.0 if isinstance(v, float) else tuple(map(value, v)) if isinstance(v, (list, tuple)) else v


def key(row):
    return tuple((v is None, str(type(v)), v) if not isinstance(v, (int, float)) else (False, "", v) for v in row)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(value(r[c]) for c in columns) for r in df.collect()), key=key)
    if name not in queries.ORACLE_SQL:
        assert got
        return
    found = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert got == sorted((tuple(value(r[i]) for i in at) for r in found.fetchall()), key=key)
