"""The contract: every query runs on the smallest tables, and equals its SQL where it has some."""

import __spark_entry__ as entry
import duckdb
import pytest
from pathlib import Path

import oracle_check


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, tiny, name):
    df = entry.queries()[name](spark, tiny)
    got = oracle_check.rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    con = duckdb.connect()
    for p in Path(tiny).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    rel = con.sql(sql)
    assert got == oracle_check.rows_of(rel.columns, rel.fetchall())
