"""Pairs met block by block, against plain loops and the joins they stand for."""

import random

import numpy as np
import pytest
from graphloom.operators import blocks, communities, graph, scoring, similar, vectors
from pyspark.sql import functions as F


@pytest.fixture
def small(monkeypatch):
    for name, value in (("SMALL", 3), ("PAIRED_ROWS", 4), ("TILE_ROWS", 3), ("TILE_COLUMNS", 5), ("MATCHES", 2), ("SPREAD", 2), ("LEAST_ROWS", 3)):
        monkeypatch.setattr(blocks, name, value)
    for name, value in (("TILE_ROWS", 3), ("TILE_COLUMNS", 5), ("BLOCK_ROWS", 4), ("BLOCK_COMPONENTS", 8)):
        monkeypatch.setattr(vectors, name, value)


def test_common_members_by_places(monkeypatch):
    monkeypatch.setattr(blocks, "MATCHES", 2)
    rnd = random.Random(1)
    a, b = ([[int(x) for x in {rnd.randrange(6) for _ in range(rnd.randrange(5))}] for _ in range(n)] for n in (7, 9))
    assert blocks.common(a, b).tolist() == [[len(set(x) & set(y)) for y in b] for x in a]
    assert blocks.jaccard([[]], [[], [1]]).tolist() == [[0.0, 0.0]]


def test_best_columns_take_the_first_of_equals(monkeypatch):
    monkeypatch.setattr(vectors, "TILE_COLUMNS", 4)
    rnd = np.random.default_rng(2)
    a, b = rnd.integers(-2, 3, (6, 3)).astype(float), rnd.integers(-2, 3, (23, 3)).astype(float)
    b[5] = np.nan
    for k in (1, 3, 7, 40):
        row, column, score = vectors._best(a, b, k, np.array([0, -1, 3, 22, -1, 7]), False)
        for i, own in enumerate([0, -1, 3, 22, -1, 7]):
            s = a[i] @ b.T
            want = sorted((j for j in range(23) if j not in (5, own)), key=lambda j: (-s[j], j))[:k]
            assert column[row == i].tolist() == want and np.allclose(score[row == i], s[want])


def test_jaccard_within_equals_the_join(spark, small):
    rnd = random.Random(3)
    sets = spark.createDataFrame([(i, rnd.randrange(8)) for i in range(20) for _ in range(rnd.randrange(5))], "id long, member long")
    items = spark.createDataFrame([(i, rnd.randrange(2), None if i == 4 else "x") for i in range(24)], "id long, k long, m string")
    a, b = (items.withColumnRenamed("id", x) for x in ("a", "b"))
    want = sorted(map(tuple, communities.jaccard(sets, a.join(b, ["k", "m"]).where("a < b").select("a", "b")).collect()))
    assert sorted(map(tuple, communities.jaccard_within(sets, items, ["k", "m"]).collect())) == want


def test_merges_of_many_entities_of_one_name(spark, small):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["a", "A ", "b", None]), None if i == 9 else [rnd.uniform(-1, 1) for _ in range(rnd.choice([2, 2, 2, 3]))]) for i in range(60)]
    for threshold in (0.3, 0.0):
        want = {}
        for i, n, v in rows:
            for j, m, w in rows:
                if i < j and n and m and n.strip().lower() == m.strip().lower() and (sum(x * y for x, y in zip(v, w)) if v and w and len(v) == len(w) else 0.0) >= threshold:
                    want[j] = min(want.get(j, i), i)
        given = spark.createDataFrame(rows, "id long, content string, embedding array<double>")
        assert {r.removed: r.survivor for r in scoring.merge_pairs(given, threshold).collect()} == want


@pytest.mark.parametrize("threshold", [0.5, 0.3])
def test_similar_pairs_of_hot_members(spark, small, threshold):
    rnd = random.Random(5)
    rows = [(i, None if i == 3 else [0.0, 0.0] if i == 5 else [rnd.uniform(-1, 1) for _ in range(3 if i % 7 == 0 else 2)]) for i in range(40)]
    near = {(i, rnd.choice([100, 101, 102, 200 + rnd.randrange(15)])) for i in range(40) for _ in range(2)}
    sets = {i: {m for j, m in near if j == i} for i, _ in rows}
    want = {}
    for i, v in rows:
        for j, w in rows:
            if i < j:
                jac = len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] | sets[j] else 0.0
                n = np.linalg.norm(v or 0) * np.linalg.norm(w or 0)
                cos = float(np.dot(v, w) / n) if v and w and len(v) == len(w) and n > 0 else 0.0
                if 0.6 * jac + 0.4 * cos >= threshold:
                    want[i, j] = (jac, cos)
    e = spark.createDataFrame(rows, "id long, embedding array<double>")
    edges = spark.createDataFrame([(i, m, "RelatesTo", 1.0) for i, m in near], "source long, target long, edge_type string, weight double")
    got = {(r.a, r.b): (r.jaccard, r.cosine) for r in similar.pairs(e, edges, threshold).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[p], want[p]) for p in got)


def test_vectors_are_sent_to_few_blocks(spark, monkeypatch):
    """3,000 vectors: each goes to one group for each block of the other side, 4 here and not one per 50."""
    monkeypatch.setattr(blocks, "SPREAD", 4)
    seen = []
    keep = vectors.met

    def counted(a, b, *rest):
        seen.append((a.count(), b.count(), rest))
        return keep(a, b, *rest)

    monkeypatch.setattr(vectors, "met", counted)
    rnd = np.random.default_rng(6)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rnd.normal(size=(300, 4)))], "id long, embedding array<float>")
    q = v.selectExpr("id as query_id", "embedding")
    got = {(r.query_id, r["rank"]): r.id for r in vectors.topk_many(q, v, 3, block_rows=50).collect()}
    m = np.array([r.embedding for r in v.orderBy("id").collect()])
    want = np.argsort(-(m @ m.T), axis=1, kind="stable")[:, :3]
    assert len(seen) == 1 and got == {(i, r + 1): int(want[i, r]) for i in range(300) for r in range(3)}


def test_items_of_a_group_are_sent_to_few_blocks(spark):
    """5,000 items of one group: each goes once to each of 4 blocks, not to 5 on either side."""
    rows = spark.range(5_000).selectExpr("id", "1 as k", "array(id) as members")
    sent = blocks.paired(rows, ["k"], F.size("members"))
    assert sent.count() == 4 * 5_000
    assert sent.select("id", "_low", "_high").distinct().count() == 4 * 5_000
    assert blocks.paired(rows, ["k"], F.lit(8_000)).where("id = 7").count() == 10


def test_every_pair_of_a_group_comes_once(spark, monkeypatch):
    for name, value in (("PAIRED_ROWS", 3), ("WITHIN_ROWS", 7)):
        monkeypatch.setattr(blocks, name, value)
    items = spark.range(45).selectExpr("id", "id % 2 as k")
    sets = spark.range(45).selectExpr("id", "id % 5 as member")
    got = [(r.a, r.b, r.jaccard) for r in communities.jaccard_within(sets, items, ["k"]).collect()]
    assert sorted(got) == [(a, b, float(a % 5 == b % 5)) for a in range(45) for b in range(a + 1, 45) if a % 2 == b % 2]


def test_a_pair_of_two_hot_members_comes_once(spark, monkeypatch):
    """All share both members, so either would give each pair; pairs that share a rare member are left to the join."""
    monkeypatch.setattr(blocks, "SMALL", 3)
    e = spark.createDataFrame([(i, [1.0, 0.1 * i]) for i in range(9)], "id long, embedding array<double>")
    sets = spark.createDataFrame([(i, m) for i in range(9) for m in (100, 101)], "id long, member long")
    first = similar._prefixes(sets, 1 / 6)
    often = first.groupBy("member").count().select("member")
    hot = similar._hot(e, sets, first, often, 0.5)
    got = [(r.a, r.b) for r in hot.collect()]
    assert sorted(got) == [(a, b) for a in range(9) for b in range(a + 1, 9)]
    assert similar._hot(e, sets, first.unionByName(spark.createDataFrame([(i, 7, 3) for i in range(9)], first.schema)), often, 0.5).count() == 0
