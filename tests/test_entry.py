import os

import duckdb
import pytest

import __spark_entry__ as entry

QUICK = [n for n in entry.oracle_sql() if n not in ("runs_grid",)]


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{data}/{f}')")
    return c


def tidy(v):
    if isinstance(v, list):
        return [tidy(x) for x in v]
    return "nan" if v != v else 0.0 if v == 0 else v


@pytest.mark.parametrize("name", QUICK)
def test_same_as_sql(spark, data, db, name):
    df = entry.queries()[name](spark, data)
    sql = db.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(sql.columns)
    order = sorted(df.columns)
    mine = sorted((tuple(tidy(r[c]) for c in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(tidy(r[sql.columns.index(c)]) for c in order) for r in sql.fetchall()), key=repr)
    assert mine == theirs


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
