"""Searches, scores and paths through hubs, against plain restatements; no step shuffles or writes the square of a hub."""

import random

import pytest
from graphloom.operators import graph


def frame(spark, rows):
    return spark.createDataFrame([(a, b, "a", 1.0) for a, b in rows], "source long, target long, edge_type string, weight double")


def depths(rows, seed, hops):
    near = {}
    for a, b in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    found, front = {seed: 0}, {seed}
    for depth in range(1, hops + 1):
        front = {n for m in front for n in near.get(m, ())} - set(found)
        found |= {n: depth for n in front}
    return found


@pytest.mark.parametrize("most", [64, 1])
def test_search_through_heavy_nodes_equals_plain_search(spark, monkeypatch, most):
    for name, value in (("HEAVY", 3), ("MOST_HEAVY", most), ("BLOCK_NEIGHBOURS", 2), ("BLOCK_SEEDS", 2), ("PAIRS_A_TASK", 50)):
        monkeypatch.setattr(graph, name, value)
    rnd = random.Random(5)
    rows = [(rnd.randrange(40), rnd.randrange(40)) for _ in range(60)] + [(100, i) for i in range(0, 40, 3)] + [(101, i) for i in range(0, 40, 2)] + [(7, 7), (100, 101)]
    seeds = [0, 3, 7, 12, 100, 101, 999]
    ids = spark.createDataFrame([(x,) for x in seeds], "id long")
    nodes = spark.createDataFrame([(i, f"n{i}") for i in (*range(30), 100)], "id long, content string")
    for hops in (1, 2, 3):
        want = sorted((s, n, d) for s in seeds for n, d in depths(rows, s, hops).items())
        assert sorted(map(tuple, graph.search(frame(spark, rows), ids, hops).select("seed", "node", "depth").collect())) == want
        got = sorted(map(tuple, graph.traverse(nodes, frame(spark, rows), ids, hops).select("seed", "node", "depth", "content").collect()))
        assert got == [(s, n, d, f"n{n}") for s, n, d in want if n < 30 or n == 100]


@pytest.mark.parametrize("floor", [True, False])
def test_hybrid_equals_plain_scores(spark, floor):
    rnd = random.Random(6)
    rows = [(rnd.randrange(30), rnd.randrange(30)) for _ in range(40)]
    seeds = [(i, s) for i, s in zip(range(0, 30, 4), (0.9, -0.5, 0.3, None, -0.1, 0.0, 0.7, 0.2))]
    given = spark.createDataFrame(seeds, "id long, score double")
    for decay in (0.5, 1.5):
        want = {}
        for seed, score in seeds:
            for n, d in depths(rows, seed, 2).items():
                value = None if score is None else score * decay**d
                want[n] = value if want.get(n) is None else want[n] if value is None else max(want[n], value)
        want = {n: max(v or 0.0, 0.0) if floor else v for n, v in want.items()}
        got = {r.id: r.score for r in graph.hybrid(frame(spark, rows), given, 2, decay, floor).collect()}
        assert got.keys() == want.keys() and all(got[n] == want[n] if want[n] is None else abs(got[n] - want[n]) < 1e-12 for n in want)


def written(monkeypatch):
    rows, keep = [], graph.checkpointed

    def counted(df):
        out = keep(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(graph, "checkpointed", counted)
    return rows


STAR = [(i, 0) for i in range(1, 301)] + [(0, 1_000)]


def test_hybrid_makes_no_pairs_at_a_hub(spark, monkeypatch):
    rows = written(monkeypatch)
    scored = spark.createDataFrame([(i, i / 300) for i in range(1, 301)], "id long, score double")
    got = {r.id: r.score for r in graph.hybrid(frame(spark, STAR), scored, 3, 0.5).collect()}
    assert got[0] == 0.5 and got[1_000] == 0.25 and got[1] == 0.25 and got[300] == 1.0
    assert max(rows) <= 2 * len(STAR)


def test_shortest_paths_meet_before_a_hub_and_take_the_least(spark, monkeypatch):
    rows = written(monkeypatch)
    pairs = spark.createDataFrame([(i, 1_000) for i in range(1, 301)], "start long, goal long")
    got = {r.start: r.path for r in graph.shortest_paths(frame(spark, STAR), pairs, 4).collect()}
    assert got == {i: [i, 0, 1_000] for i in range(1, 301)}
    assert max(rows) <= 2 * len(STAR)


def test_shortest_paths_equal_plain_search(spark):
    rnd = random.Random(8)
    edges = [(rnd.randrange(25), rnd.randrange(25)) for _ in range(32)]
    pairs = [(a, b) for a in range(0, 25, 3) for b in range(0, 25, 2)] + [(0, 99)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for most in (2, 100):
        want = {}
        for a, b in pairs:
            paths, seen = [[a]], {a}
            for _ in range(most + 1):
                if hit := [p for p in paths if p[-1] == b]:
                    want[a, b] = min(hit)
                    break
                paths = [p + [n] for p in paths for n in near.get(p[-1], ()) if n not in seen]
                seen |= {p[-1] for p in paths}
        asked = spark.createDataFrame(pairs, "start long, goal long")
        assert {(r.start, r.goal): r.path for r in graph.shortest_paths(frame(spark, edges), asked, most).collect()} == want


def test_paths_between_do_not_walk_a_hub_out(spark, monkeypatch):
    rows = written(monkeypatch)
    starts = spark.createDataFrame([(i,) for i in range(1, 301)], "id long")
    goals = spark.createDataFrame([(1_000,)], "goal long")
    got = graph.paths_between(frame(spark, STAR), starts, goals, 3).collect()
    assert sorted((r.start, r.nodes) for r in got) == [(i, [i, 0, 1_000]) for i in range(1, 301)]
    assert max(rows) <= 2 * len(STAR)


def test_links_of_a_search_are_written_once(spark, monkeypatch):
    rows = written(monkeypatch)
    given = [*STAR, (0, 1), (5, 5), (None, 7), (7, None), (None, None)]
    got = [tuple(r) for r in graph._linked(frame(spark, given)).select("node", "neighbour").collect()]
    assert len(got) == len(set(got)) and set(got) == set(given) | {(b, a) for a, b in given}
    assert rows == [len(STAR) + 3]


def test_traverse_walks_on_only_to_what_is_asked(spark):
    """Walks through light nodes are narrowed to the asked nodes before they are made distinct and hydrated."""
    edges = frame(spark, [*STAR, (1, 400), (400, 401), (400, 402)])
    nodes = spark.createDataFrame([(2, "two"), (401, "far")], "id long, content string")
    ids = spark.createDataFrame([(1,)], "id long")
    found = graph.traverse(nodes, edges, ids, 2)
    assert sorted(map(tuple, found.select("seed", "node", "depth", "content").collect())) == [(1, 2, 2, "two"), (1, 401, 2, "far")]
    semi = lambda df: df._jdf.queryExecution().analyzed().toString().count("LeftSemi")
    assert semi(found) == semi(graph.search(edges, ids, 2)) + 1
