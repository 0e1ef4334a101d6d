from graphloom.operators import communities, facts, graph, reward, scoring, vectors
from pyspark.sql import functions as F


def edges(spark, rows):
    return spark.createDataFrame([(a, b, t, 1.0) for a, b, t in rows], "source long, target long, edge_type string, weight double")


def ids(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "id long")


def test_search_takes_the_least_depth_and_both_directions(spark):
    e = edges(spark, [(1, 2, "RelatesTo"), (2, 3, "RelatesTo"), (1, 3, "Actor"), (4, 3, "RelatesTo")])
    found = {(r.node, r.depth) for r in graph.search(e, ids(spark, 1), 2).collect()}
    assert found == {(1, 0), (2, 1), (3, 1), (4, 2)}
    assert {r.node for r in graph.neighbours(e, ids(spark, 1), 1, F.col("edge_type") == "Actor").collect()} == {3}


def test_shortest_path_breaks_ties_and_finds_none(spark):
    e = edges(spark, [(1, 2, "a"), (1, 3, "a"), (2, 4, "a"), (3, 4, "a"), (8, 9, "a")])
    pairs = spark.createDataFrame([(1, 4), (1, 9), (5, 5)], "start long, goal long")
    assert {(r.start, r.goal): r.path for r in graph.shortest_paths(e, pairs).collect()} == {(1, 4): [1, 2, 4], (5, 5): [5]}


def test_simple_paths_count_parallel_edges_and_no_cycles(spark):
    e = edges(spark, [(1, 2, "Actor"), (1, 2, "Object"), (2, 3, "Actor"), (3, 1, "Actor")])
    pairs = spark.createDataFrame([(1, 3)], "start long, goal long")
    found = sorted((r.nodes, r.types) for r in graph.simple_paths(e, pairs, 3).collect())
    assert found == [([1, 2, 3], ["Actor", "Actor"]), ([1, 2, 3], ["Object", "Actor"]), ([1, 3], ["Actor"])]


def test_reward_of_a_known_path(spark):
    row = spark.range(1).select(reward.coherence(F.array(*[F.lit(x) for x in ("Actor", "Object", "CausedBy")])).alias("c"), reward.reward(F.lit(2), F.lit(0.5), F.lit(0.5)).alias("r")).first()
    assert abs(row.c - 0.5) < 1e-12 and abs(row.r - (0.4 * 0.64 + 0.2 + 0.1)) < 1e-12


def test_components_of_a_long_chain(spark):
    e = edges(spark, [(i, i + 1, "a") for i in range(30)] + [(100, 101, "a")])
    assert {r.id: r.component for r in graph.connected_components(e).collect()} == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}


def test_two_cliques_are_two_communities(spark):
    rows = [(a, b, "a") for c in (0, 10) for a in range(c, c + 5) for b in range(a + 1, c + 5)] + [(4, 10, "a")]
    found = {r.node_id: r.community_id for r in communities.label_propagation(edges(spark, rows)).collect()}
    assert found == {**{i: 0 for i in range(5)}, **{i: 10 for i in range(10, 15)}}
    new = spark.createDataFrame([(i, 0) for i in range(5)], "node_id long, community_id long")
    old = spark.createDataFrame([(i, 0) for i in range(4)] + [(9, 9)], "node_id long, community_id long")
    assert {r.node_id for r in communities.changed(old, new).collect()} == {0, 1, 2, 3, 4, 9}


def test_entity_clusters_need_shared_neighbours(spark):
    e = edges(spark, [(1, 10, "a"), (2, 10, "a"), (3, 11, "a"), (1, 12, "a"), (2, 12, "a")])
    x = spark.createDataFrame([(1, "apple", [1.0, 0.0]), (2, "Apple ", [0.0, 1.0]), (3, "apple", [0.0, 1.0])], "id long, content string, embedding array<double>")
    assert {r.id: r.cluster_id for r in communities.entity_clusters(x, e).collect()} == {1: 1, 2: 1, 3: 3}
    y = spark.createDataFrame([(1, "b", [1.0]), (2, "B", [1.0]), (5, "b", [1.0])], "id long, content string, embedding array<double>")
    assert {(r.removed, r.survivor) for r in scoring.merge_pairs(y).collect()} == {(2, 1), (5, 1)}


def test_resolution_thresholds_are_strict(spark):
    year = facts.TEMPORAL_SECONDS
    rows = [(1, 1, "p", "a", 0.0, 0, "Accepted"), (2, 1, "p", "b", 0.3, year, "Accepted"), (3, 2, "p", "a", 0.5, 0, "Accepted"), (4, 2, "p", "b", 0.1, year + 1, "Accepted"), (5, 3, "p", "a", 0.2, 0, "Accepted"), (6, 3, "p", "b", 0.75, 9, "Accepted")]
    f = spark.createDataFrame(rows, "id long, subject long, predicate string, object string, source_confidence double, timestamp long, state string")
    got = {r.old_id: (r.strategy, r.winner) for r in facts.resolve(f).collect()}
    assert got == {1: ("Ambiguous", 1), 3: ("Temporal", 4), 5: ("Confidence", 6)}


def test_topk_skips_other_lengths(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [1.0]), (4, None)], "id long, embedding array<double>")
    assert [r.id for r in vectors.topk(v, [1.0, 0.0], 5).collect()] == [1, 2]
    assert vectors.topk(v, [1.0, 0.0], 0).count() == 0
    q = v.select(F.col("id").alias("query_id"), "embedding")
    assert {(r.query_id, r.id) for r in vectors.topk_many(q, v, 1, block_rows=1).collect()} == {(1, 1), (2, 2), (3, 3)}
