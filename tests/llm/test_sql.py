"""Queries of the text operators against their SQL."""

from __future__ import annotations

import pytest

from vicinal.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rel = con.sql(SQL[name])
    assert sorted(rel.columns) == columns
    places = [rel.columns.index(c) for c in columns]
    tidy = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert tidy(tuple(r[c] for c in columns) for r in df.collect()) == tidy(tuple(r[i] for i in places) for r in rel.fetchall())
