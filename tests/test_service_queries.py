"""Queries of lookups, exports, texts and sources against their SQL in DuckDB."""

import os

import duckdb
import pytest

from graphloom import queries as core
from graphloom import service_queries

FOLDER = "/root/testdata/sf0.001"
NAMES = [n for n, f in core.QUERIES.items() if f.__module__ == service_queries.__name__ and n in core.ORACLES]


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def rows(columns, found):
    return sorted(tuple(repr(round(v, 9) + 0.0) if isinstance(v, float) else repr(v) for v in r) for r in found), columns


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    frame = core.QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    relation = duck.sql(core.ORACLES[name])
    names = sorted(relation.columns)
    expected = duck.sql("SELECT " + ", ".join(f'"{c}"' for c in names) + f" FROM ({core.ORACLES[name]})").fetchall()
    assert rows(columns, [tuple(r) for r in frame.select(*columns).collect()]) == rows(names, expected)
