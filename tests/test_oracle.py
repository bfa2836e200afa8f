"""Every registered query of the cell operators against its SQL twin in DuckDB."""

import duckdb
import pytest

from cellweave.plans.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def rows_of(names, columns, rows):
    order = [columns.index(c) for c in names]
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    got = df.collect()
    cursor = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    names = sorted(df.columns)
    assert names == sorted(columns)
    assert rows_of(names, df.columns, got) == rows_of(names, columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_with_stable_schema(spark, small, name):
    df = QUERIES[name](spark, small)
    assert df.columns and all(len(r) == len(df.columns) for r in df.collect())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
