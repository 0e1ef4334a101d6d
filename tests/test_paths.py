"""Simple paths that meet in the middle, against plain enumeration."""

import random

from graphloom.operators import graph
from pyspark.sql import functions as F


def plain(edges, start, goal, hops):
    """All simple undirected paths by depth-first search; parallel edges count apart."""
    out = []

    def go(nodes, types):
        if nodes[-1] == goal:
            out.append((tuple(nodes), tuple(types)))
            return
        if len(types) < hops:
            for a, b, t in edges:
                for x, y in ((a, b), (b, a)):
                    if x == nodes[-1] and y not in nodes:
                        go([*nodes, y], [*types, t])

    go([start], [])
    return sorted(out)


def test_paths_equal_enumeration(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(9), rnd.randrange(9), rnd.choice("ab")) for _ in range(16)] + [(3, 3, "a"), (0, 1, "a"), (0, 1, "b"), (20, 21, "a")]
    frame = spark.createDataFrame([(a, b, t, 1.0) for a, b, t in edges], "source long, target long, edge_type string, weight double")
    pairs = [(0, 5), (0, 1), (1, 0), (2, 7), (4, 4), (3, 8), (0, 20), (99, 0)]
    asked = spark.createDataFrame(pairs + pairs[:1], "start long, goal long")
    for hops in (1, 2, 3, 4, 5):
        got = {}
        for r in graph.simple_paths(frame, asked, hops, None).collect():
            assert r.hops == len(r.types) == len(r.nodes) - 1
            got.setdefault((r.start, r.goal), []).append((tuple(r.nodes), tuple(r.types)))
        want = {p: plain(edges, *p, hops) for p in pairs if p[0] != p[1]}
        assert {p: sorted(v) for p, v in got.items()} == {p: v for p, v in want.items() if v}
    few = graph.simple_paths(frame, asked, 4, 2).groupBy("start", "goal").agg(F.sort_array(F.collect_list(F.struct("hops", "nodes", "types"))).alias("p")).collect()
    for r in few:
        assert [(tuple(x.nodes), tuple(x.types)) for x in r.p] == sorted(plain(edges, r.start, r.goal, 4), key=lambda x: (len(x[1]), x))[:2]


def test_paths_between_all_starts_and_goals(spark):
    rnd = random.Random(9)
    edges = [(rnd.randrange(12), rnd.randrange(12), rnd.choice("ab")) for _ in range(24)]
    frame = spark.createDataFrame([(a, b, t, 1.0) for a, b, t in edges], "source long, target long, edge_type string, weight double")
    starts, goals = [0, 1, 2, 77], [5, 6, 7]
    ids = spark.createDataFrame([(x,) for x in starts], "id long")
    ends = spark.createDataFrame([(x,) for x in goals], "goal long")
    for hops in (1, 2, 3, 4):
        got = sorted((r.start, r.goal, tuple(r.nodes), tuple(r.types)) for r in graph.paths_between(frame, ids, ends, hops).collect())
        want = [(s, g, n, t) for s in starts for g in goals for n, t in plain(edges, s, g, hops) if not set(n[:-1]) & set(goals)]
        assert got == sorted(want)


def test_a_hub_is_not_walked_through_and_out(spark, monkeypatch):
    """Both ends hang on a hub of 3,000 leaves: no hop writes more rows than the hub's edges for each end."""
    rows = [(i, 0, "a", 1.0) for i in range(1, 3_001)] + [(5_000, 1, "a", 1.0), (5_001, 2, "a", 1.0)]
    frame = spark.createDataFrame(rows, "source long, target long, edge_type string, weight double")
    written = []
    keep = graph.checkpointed

    def counted(df):
        out = keep(df)
        if "nodes" in df.columns:
            written.append(out.count())
        return out

    monkeypatch.setattr(graph, "checkpointed", counted)
    pairs = spark.createDataFrame([(5_000, 5_001)], "start long, goal long")
    assert [r.nodes for r in graph.simple_paths(frame, pairs, 4).collect()] == [[5_000, 1, 0, 2, 5_001]]
    assert written and max(written) <= 3


def test_path_counts_equal_the_paths(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK_ENDS", 2)
    monkeypatch.setattr(graph.blocks, "TILE_COLUMNS", 1)
    monkeypatch.setattr(graph.blocks, "TILE_ROWS", 3)
    rnd = random.Random(10)
    edges = [(rnd.randrange(12), rnd.randrange(12), rnd.choice("ab")) for _ in range(30)] + [(i, 50, "a") for i in range(12)] + [(50, 0, "b"), (3, 3, "a"), (None, 3, "a"), (7, None, "a")]
    frame = spark.createDataFrame([(a, b, t, 1.0) for a, b, t in edges], "source long, target long, edge_type string, weight double")
    ids = spark.createDataFrame([(x,) for x in [0, 1, 2, 3, 5, 77, 0]], "id long")
    ends = spark.createDataFrame([(x,) for x in [5, 6, 7, 8, 9, 0, 6]], "goal long")
    for hops in (1, 2, 3, 4):
        paths = graph.paths_between(frame, ids, ends, hops).groupBy("start", "goal", "hops").count()
        got = graph.path_counts(frame, ids, ends, hops).select("start", "goal", "hops", "paths")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, paths.collect()))
        if hops > 3:
            assert got.count() > 0


def test_path_counts_send_walks_and_no_pairs(spark, monkeypatch):
    """200 starts and 300 goals around one node: 60,000 pairs come out, 500 rows go to the blocks."""
    rows = [(i, 0, "a", 1.0) for i in range(1, 501)] + [(1, 600, "a", 1.0), (600, 201, "a", 1.0)]
    frame = spark.createDataFrame(rows, "source long, target long, edge_type string, weight double")
    moved, keep = [], graph._sent_counts

    def counted(*given):
        out = keep(*given)
        moved.append(out.count())
        return out

    monkeypatch.setattr(graph, "_sent_counts", counted)
    found = graph.path_counts(frame, spark.range(1, 201), spark.range(201, 501).toDF("goal"), 3)
    got = {(r.start, r.goal, r.hops): r.paths for r in found.collect()}
    assert got == {(a, b, 2): 1 + ((a, b) == (1, 201)) for a in range(1, 201) for b in range(201, 501)}
    assert moved and max(moved) <= 510
