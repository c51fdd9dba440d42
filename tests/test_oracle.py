"""Every query with SQL against DuckDB on the same tables, column by column."""

from __future__ import annotations

import math

import duckdb
import pytest

from roadledger.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return round(value, 9)
    return value


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(row[k]) for k in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    cursor = duck.execute(catalog.ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert bag(df.columns, got) == bag(columns, cursor.fetchall())
    assert got
