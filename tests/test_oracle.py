"""Every query with SQL has to give the same rows as an independent engine."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    yield con
    con.close()


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        return repr(v + 0.0) if isinstance(v, float) else str(v)

    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(name, spark, sf, duck):
    df = entry.queries()[name](spark, sf)
    found = canonical([tuple(r) for r in df.collect()], df.columns)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    types = dict(zip(columns, (str(d[1]) for d in cursor.description)))
    wanted = canonical(cursor.fetchall(), columns)
    assert found == wanted
    assert {c: TYPES[t] for c, t in df.dtypes} == types


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 24


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
