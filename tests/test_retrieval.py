"""The whole retrieval against a brute-force version, query by query and pair by pair."""

from graphloom.operators import graph
from graphloom.plans import retrieval

NOW, DAY = 1_000_000_000, 86_400
NODES = [(i, f"m{i}", "Entity", NOW - i * DAY, "other" if i in (7, 12) else None) for i in range(1, 15)]
EDGES = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (2, 5), (6, 7), (8, 9), (9, 10), (1, 2), (3, 8), (11, 1)]
TYPES = ["Actor", "Object", "RelatesTo", "CausedBy"]
VECTORS = {i: [1.0, (i * 7 % 11) / 5.0 - 1.0, (i * 3 % 7) / 4.0] for i in range(1, 15)}
QUERIES = {100: [1.0, 0.5, 0.2], 101: [0.1, -1.0, 0.9]}
PLACED = [(i, 1 if i < 9 else 9) for i in range(1, 15)]


def typed():
    return [(a, b, TYPES[k % 4]) for k, (a, b) in enumerate(EDGES)]


def simple_paths(start, goal, hops):
    near = {}
    for a, b, t in typed():
        near.setdefault(a, []).append((b, t))
        near.setdefault(b, []).append((a, t))
    out, todo = [], [([start], [])]
    while todo:
        nodes, types = todo.pop()
        if nodes[-1] == goal and types:
            out.append((len(types), nodes, types))
        elif len(types) < hops:
            todo += [([*nodes, x], [*types, t]) for x, t in near.get(nodes[-1], []) if x not in nodes]
    return sorted(out)


def reward_of(nodes, types):
    group = {"RelatesTo": 0, "CausedBy": 1, "Actor": 3, "Object": 3}
    steps = [1.0 if a == b else 0.7 if group[a] == group[b] else 0.3 for a, b in zip(types, types[1:])]
    inner = [sum((a == n) + (b == n) for a, b in EDGES) for n in nodes[1:-1]]
    central = sum(inner) / len(inner) / max(inner) if inner else 0.5
    return min(1.0, 0.4 * 0.8 ** len(types) + 0.4 * (sum(steps) / len(steps) if steps else 1.0) + 0.2 * central)


def expected(query, plan):
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(y * y for y in b) ** 0.5)
    seeds = dict(sorted(((i, cosine(query, v)) for i, v in VECTORS.items()), key=lambda x: (-x[1], x[0]))[: plan.seeds])
    near = {i: {b for a, b in EDGES if a == i} | {a for a, b in EDGES if b == i} for i in VECTORS}
    inside = {n[0] for n in NODES if plan.namespace in (None, n[4] or "default")}
    found = {}
    for i in set(VECTORS) & inside:
        reached = [s * plan.decay for j, s in seeds.items() if i in near[j]]
        if i in seeds or reached:
            found[i] = seeds[i] if i in seeds else max(reached)
    own = {c for n, c in PLACED if n in seeds}
    for i in sorted(n for n, c in PLACED if c in own and n not in found)[: plan.members]:
        if i in inside:
            found[i] = plan.member_similarity
    degree = {i: len(near[i]) or 1 for i in found}
    rows = []
    for i, similarity in found.items():
        paths = [p for s in seeds for p in simple_paths(s, i, plan.path_hops)[:10]]
        path = 1.0 if i in seeds else max((reward_of(n, t) for _, n, t in paths), default=0.0)
        recent = 0.5 ** ((NOW - NODES[i - 1][3]) / (30 * DAY))
        base = 0.5 * similarity + 0.3 * degree[i] / max(degree.values()) + 0.2 * recent
        rows.append((0.7 * base + 0.15 * path, i, similarity, path))
    return sorted(rows, key=lambda r: (-round(r[0], 9), r[1]))[: plan.top_k]


def test_retrieval_equals_brute_force(spark):
    nodes = spark.createDataFrame(NODES, "id long, content string, node_type string, timestamp long, namespace string")
    edges = spark.createDataFrame([(a, b, t, 1.0) for a, b, t in typed()], "source long, target long, edge_type string, weight double")
    unit = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    vectors = spark.createDataFrame([(i, unit(v)) for i, v in VECTORS.items()], "id long, embedding array<double>")
    queries = spark.createDataFrame([(i, unit(v)) for i, v in QUERIES.items()], "query_id long, embedding array<double>")
    placed = spark.createDataFrame(PLACED, "node_id long, community_id long")
    for plan in (retrieval.Retrieval(seeds=2, top_k=20, now=NOW, members=3), retrieval.Retrieval(seeds=3, top_k=5, now=NOW, members=4, namespace="default")):
        got = retrieval.retrieve(queries, nodes, edges, vectors, plan, placed=placed).collect()
        for q, v in QUERIES.items():
            mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
            want = expected(v, plan)
            assert [r.id for r in mine] == [w[1] for w in want]
            for r, w in zip(mine, want):
                assert max(abs(r.score - w[0]), abs(r.similarity - w[2]), abs(r.path_reward - w[3])) < 1e-9


def test_paths_into_goals_are_all_the_simple_paths(spark):
    edges = spark.createDataFrame([(a, b, t, 1.0) for a, b, t in typed()], "source long, target long, edge_type string, weight double")
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "id long")
    for hops in (1, 2, 3, 4):
        got = sorted((r.start, r.goal, r.nodes, r.types) for r in graph.paths_from(edges, ids([1, 3]), hops, ids([2, 5, 10]), None).collect())
        assert got == sorted((s, g, n, t) for s in (1, 3) for g in (2, 5, 10) for _, n, t in simple_paths(s, g, hops))
