"""The corpus queries that SQL can express, against DuckDB over whole tables."""

import duckdb
import pytest

from tidemark.llm import queries as Q

SQL = Q.oracle_sql()


@pytest.mark.parametrize("name", SQL)
def test_same_rows_as_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    df = Q.queries()[name](spark, sf)
    columns = sorted(df.columns)
    found = con.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    order = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=order) == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=order)
