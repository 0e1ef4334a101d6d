"""Vectors by cell on disk: pruned scans, moves, clearing, emptied cells, stubs."""

import random

from graphloom.operators import codes
from graphloom.sources import indexed
from pyspark.sql import functions as F


def test_cells_stay_right(spark, tmp_path):
    rnd = random.Random(6)
    corner = [[3.0, 0.0, 0.0, 0.0], [0.0, 3.0, 0.0, 0.0], [0.0, 0.0, 3.0, 0.0]]
    near = lambda c: [x + rnd.gauss(0, 0.1) for x in corner[c]]
    rows = [(i, near(i % 2)) for i in range(60)] + [(60, near(2)), (61, None), (62, [1.0])]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    book, path = codes.fit(v, 3, parts=2), str(tmp_path / "t")
    indexed.build(v, path, book)
    home = {r.id: r.cell for r in indexed.read(spark, path).collect()}
    assert set(home) == set(range(61)) and len({home[0], home[1], home[60]}) == 3

    scan = indexed.read(spark, path, [home[0]])
    assert "PartitionFilters: [" in (plan := scan._jdf.queryExecution().toString()) and "cell#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r.id for r in scan.collect()} == {i for i in range(60) if i % 2 == 0}

    stamp = lambda cell: sorted(p.name for p in (tmp_path / "t" / f"cell={cell}").glob("*.parquet"))
    lone = stamp(home[60])
    put = spark.createDataFrame([(0, near(1)), (100, near(1)), (3, near(1)), (3, [9.0] * 4), (5, None)], "id long, embedding array<double>")
    clear = spark.createDataFrame([(1,), (777,), (0,)], "id long")
    assert indexed.change(spark, path, book, put, clear) == {home[0], home[1]} | {r.cell for r in indexed.read(spark, path).where("id = 3").collect()}
    now = {r.id: r for r in indexed.read(spark, path).collect()}
    assert set(now) == (set(range(61)) - {1, 5}) | {100}
    assert now[0].cell == home[1] and now[100].cell == home[1] and now[3].embedding == [9.0] * 4
    fresh = {r.id: (r.cell, r.code) for r in indexed.placed(indexed.read(spark, path).select("id", "embedding"), book).collect()}
    assert {i: (r.cell, r.code) for i, r in now.items()} == fresh
    if now[3].cell != home[60]:
        assert stamp(home[60]) == lone
    # the last vector of a cell leaves
    left = [r.id for r in now.values() if r.cell == home[60]]
    indexed.change(spark, path, book, clear=spark.createDataFrame([(i,) for i in left], "id long"))
    assert not (tmp_path / "t" / f"cell={home[60]}").exists()
    assert {r.id for r in indexed.read(spark, path).collect()} == set(now) - set(left)
    assert indexed.change(spark, path, book, clear=spark.createDataFrame([(12345,)], "id long")) == set()


def test_stubs(spark):
    nodes = spark.createDataFrame([(1, "a", "Fact", 5, "n")], "id long, content string, node_type string, timestamp long, namespace string")
    v = spark.createDataFrame([(1, [1.0]), (2, [1.0]), (2, [2.0])], "id long, embedding array<double>")
    got = sorted(map(tuple, indexed.with_stubs(nodes, v).collect()))
    assert got == [(1, "a", "Fact", 5, "n"), (2, None, "Entity", 0, "default")]
    kept = indexed.with_stubs(nodes, v.where(F.col("id") > 1)).where("id = 1")
    assert kept.count() == 1  # a node keeps its place without a vector
