"""Every registered query runs; those with SQL give the same rows as DuckDB."""

import duckdb
import pytest
from geomill import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sql, name):
    df = catalog.QUERIES[name](spark, D)
    columns = sorted(df.columns)
    rows = sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))
    if name not in catalog.ORACLE_SQL:
        assert rows or name == "cluster_shapes"
        return
    got = sql.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted(map(repr, (tuple(r[i] for i in order) for r in got.fetchall())))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
