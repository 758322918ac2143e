"""Every query runs, and equals its SQL where it has any."""

from __future__ import annotations

import os

import pytest

from vicinal.plans.queries import QUERIES, SQL


def tidy(rows, columns):
    return sorted((tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in rows), key=repr), columns


@pytest.fixture(scope="module")
def con(sf_dir):
    import duckdb

    made = duckdb.connect()
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            made.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{sf_dir}/{name}'")
    return made


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = tidy([tuple(r[c] for c in columns) for r in df.collect()], columns)
    rel = con.sql(SQL[name])
    places = [rel.columns.index(c) for c in sorted(rel.columns)]
    assert got == tidy([tuple(r[i] for i in places) for r in rel.fetchall()], sorted(rel.columns))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["event_id", "fraud_count", "fraud_score", "approved"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
