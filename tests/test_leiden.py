"""Leiden communities on graphs whose answer is known, and properties that any answer must have."""

import itertools

import numpy as np
from graphloom.operators import communities, leiden


def frame(spark, rows):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], "source long, target long, weight double")


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.community_id, set()).add(r.node_id)
    assert all(name == min(members) for name, members in out.items())
    return sorted(map(sorted, out.values()))


def clique(nodes, w=1.0):
    return [(a, b, w) for a, b in itertools.combinations(nodes, 2)]


def planted(seed, groups_=6, size=12, inside=0.5, across=0.02):
    rng = np.random.default_rng(seed)
    n = groups_ * size
    return [(a, b, round(float(rng.uniform(0.5, 1.5)), 2)) for a, b in itertools.combinations(range(n), 2) if rng.random() < (inside if a // size == b // size else across)]


def quality(rows, parts, kind, resolution):
    """By the definition, over a dense matrix."""
    home = {v: i for i, p in enumerate(parts) for v in p}
    inner = sum(w for a, b, w in rows if home[a] == home[b])
    if kind == "cpm":
        return inner - resolution * sum(len(p) * (len(p) - 1) / 2 for p in parts)
    m, k = sum(w for *_, w in rows), {}
    for a, b, w in rows:
        k[a], k[b] = k.get(a, 0) + w, k.get(b, 0) + w
    return inner - resolution / (4 * m) * sum(sum(k[v] for v in p) ** 2 for p in parts)


def connected(rows, part):
    near = {v: set() for v in part}
    for a, b, _ in rows:
        if a in near and b in near:
            near[a].add(b)
            near[b].add(a)
    seen, todo = set(), [next(iter(part))]
    while todo:
        v = todo.pop()
        if v not in seen:
            seen.add(v)
            todo += near[v]
    return seen == set(part)


def test_known_graphs(spark):
    """Under CPM components do not touch each other, so one run holds many graphs."""
    two = clique([1, 2, 3, 4]) + clique([5, 6, 7, 8]) + [(4, 5, 0.1)]
    three = clique(range(11, 15)) + clique(range(15, 19)) + clique(range(19, 23)) + [(14, 15, 0.05), (18, 19, 0.05)]
    pairs = [(30, 31, 1), (31, 30, 0.5), (33, 32, 1)]
    loops = [(40, 40, 1.0), (41, 41, 1.0), (1, 1, 9.0)]
    many = [(100 * c + i + 1001, 100 * c + j + 1001, 1.0) for c in range(10) for i in range(100) for j in range(i + 1, 100) if (i + j) % 5 == 0]
    many += [(c * 100 + 1001, c * 100 + 1101, 0.01) for c in range(9)]
    rows = two + three + pairs + loops + many
    found = groups(leiden.leiden(frame(spark, rows)))
    small = [p for p in found if p[0] < 100]
    assert small == [[1, 2, 3, 4], [5, 6, 7, 8], [11, 12, 13, 14], [15, 16, 17, 18], [19, 20, 21, 22], [30, 31], [32, 33]]
    large = [p for p in found if p[0] >= 100]
    assert len(large) >= 5 and all(len({(v - 1001) // 100 for v in p}) == 1 for p in large)
    assert sorted(v for p in large for v in p) == list(range(1001, 2001))
    assert groups(leiden.leiden(frame(spark, loops[:2]))) == []
    path = [(1, 2, 1), (2, 3, 1), (3, 4, 1), (4, 5, 1)]
    assert groups(leiden.leiden(frame(spark, path), resolution=0.01)) == [[1, 2, 3, 4, 5]]


def test_modularity_of_planted_groups(spark):
    rows = planted(1)
    edges = frame(spark, rows)
    found = leiden.leiden(edges, "modularity", 1.0)
    parts = groups(found)
    assert parts == [list(range(c * 12, c * 12 + 12)) for c in range(6)]
    got = leiden.quality_of(edges, found, "modularity", 1.0).first().quality
    assert abs(got - quality(rows, parts, "modularity", 1.0)) < 1e-3
    assert got >= leiden.quality_of(edges, communities.label_propagation(edges), "modularity", 1.0).first().quality - 1e-6


def test_properties_of_noisy_graphs(spark):
    rows = planted(3, groups_=6, size=10, inside=0.35, across=0.05)
    edges = frame(spark, rows).repartition(3)
    before = None
    for resolution in (0.05, 0.3):
        found = leiden.leiden(edges, "cpm", resolution)
        parts = groups(found)
        assert all(connected(rows, p) for p in parts)
        got = leiden.quality_of(edges, found, "cpm", resolution).first().quality
        assert abs(got - quality(rows, parts, "cpm", resolution)) < 1e-3
        assert before is None or len(parts) > before
        before = len(parts)
    plain = leiden.quality_of(edges, communities.label_propagation(edges), "cpm", 0.3).first().quality
    assert got >= plain - 1e-6
    carried = leiden.leiden(edges, "cpm", 0.3, start=found)  # goes on from an earlier partition
    assert quality(rows, groups(carried), "cpm", 0.3) >= quality(rows, parts, "cpm", 0.3) - 1e-6


def test_again_equals_a_full_run(spark):
    shift = lambda rows, by: [(a + by, b + by, w) for a, b, w in rows]
    graphs = [planted(s, 3, 7, 0.6, 0.04) for s in (5, 6)]
    base = graphs[0] + shift(graphs[1], 100)
    other = shift(planted(7, 2, 6, 0.7, 0.05), 300)  # no change here
    base += other
    steps = [base, [e for e in base if e[0] != 104 and e[1] != 104] + [(3, 107, 4.0), (900, 901, 1.0)]]
    placed = leiden.leiden(frame(spark, steps[0]))
    for old, new in zip(steps, steps[1:]):
        again = leiden.leiden_again(frame(spark, old), frame(spark, new), placed)
        full = leiden.leiden(frame(spark, new))
        assert groups(again) == groups(full)
        changed = {r.node_id for r in communities.changed(placed, again).collect()}
        a, b = ({v: frozenset(p) for p in groups(x) for v in p} for x in (placed, again))
        assert changed == {v for v in a.keys() | b.keys() if a.get(v) != b.get(v)}
        placed = again
