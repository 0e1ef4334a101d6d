"""Queries over their whole tables, against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from graphloom import more_queries, queries as core  # noqa: F401  (more_queries registers its queries)

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def both(spark, duck, name):
    """Sorted rows of the query and of its SQL."""
    frame = core.QUERIES[name](spark, FOLDER)
    names = ", ".join(f'"{c}"' for c in frame.columns)
    plain = lambda found: sorted(tuple(repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v) for v in r) for r in found)
    return plain(frame.collect()), plain(duck.execute(f"SELECT {names} FROM ({core.ORACLES[name]})").fetchall())


def test_every_order_is_a_message_with_its_entities(spark, duck):
    got, want = both(spark, duck, "messages_with_entities")
    assert got == want
    assert len(got) == duck.execute("SELECT count(*) FROM orders").fetchall()[0][0]
