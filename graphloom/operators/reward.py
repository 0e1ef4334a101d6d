"""Path rewards (G7-G10, C19): hop decay, predicate coherence and centrality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import graph

# Groups of edge types that go together.
GROUPS = {"RelatesTo": 0, "HasProperty": 0, "CausedBy": 1, "Supersedes": 1, "NextEpisode": 1, "ConflictsWith": 2, "Actor": 3, "Object": 3, "Location": 3, "Companion": 3}
SAME, RELATED, UNRELATED = 1.0, 0.7, 0.3
DECAY, COHERENCE_WEIGHT, CENTRALITY_WEIGHT = 0.8, 0.4, 0.2


def coherence(types) -> Column:
    """Mean over neighbouring edge types of 1.0 (same), 0.7 (same group) or 0.3; 1.0 for one edge or none."""
    t = F.col(types) if isinstance(types, str) else types
    groups = F.create_map(*[F.lit(x) for kv in GROUPS.items() for x in kv])
    pair = lambda a, b: F.when(a == b, SAME).when(F.element_at(groups, a) == F.element_at(groups, b), RELATED).otherwise(UNRELATED)
    n = F.size(t) - 1
    scores = F.zip_with(F.slice(t, F.lit(1), F.greatest(n, F.lit(0))), F.slice(t, F.lit(2), F.greatest(n, F.lit(0))), pair)
    return F.when(n < 1, 1.0).otherwise(F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / n)


def reward(hops, coherent, central, decay: float = DECAY, coherence_weight: float = COHERENCE_WEIGHT, centrality_weight: float = CENTRALITY_WEIGHT) -> Column:
    """Weighted sum of decay^hops, coherence and centrality, within 0 and 1."""
    as_column = lambda x: F.col(x) if isinstance(x, str) else x
    total = (1 - coherence_weight - centrality_weight) * F.pow(F.lit(decay), as_column(hops)) + coherence_weight * as_column(coherent) + centrality_weight * as_column(central)
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def with_centrality(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """G9 (Q6): mean degree of a path's inner nodes over the largest degree among them; 0.5 for two nodes or fewer.

    Paths that carry ``degrees`` (as ``paths_from`` gives) need no join.
    """
    if "degrees" in paths.columns:
        inside = F.slice("degrees", F.lit(1), F.greatest(F.size("degrees") - 1, F.lit(0)))
        mean = F.aggregate(inside, F.lit(0).cast("long"), lambda a, x: a + x) / F.size(inside)
        return paths.withColumn("centrality", F.when(F.size(inside) > 0, mean / F.array_max(inside)).otherwise(0.5))
    inner = paths.select("path_id", F.explode(F.slice("nodes", F.lit(2), F.greatest(F.size("nodes") - 2, F.lit(0)))).alias("id"))
    scored = inner.join(graph.degrees(edges), "id").groupBy("path_id").agg((F.avg("degree") / F.max("degree")).alias("_central"))
    return paths.join(scored, "path_id", "left").withColumn("centrality", F.coalesce("_central", F.lit(0.5))).drop("_central")


def score_paths(paths: DataFrame, edges: DataFrame, **weights) -> DataFrame:
    """``paths`` with ``coherence, centrality, reward``."""
    scored = with_centrality(paths, edges).withColumn("coherence", coherence("types"))
    return scored.withColumn("reward", reward("hops", "coherence", "centrality", **weights))


def best_rewards(edges: DataFrame, seeds: DataFrame, candidates: DataFrame, max_hops: int = 3, max_paths: int = 10) -> DataFrame:
    """C19 (Q5): ``(id, path_reward)``: the best path of a candidate to any seed; a seed itself has 1.0."""
    paths = graph.paths_from(edges, seeds, max_hops, candidates, max_paths)
    best = score_paths(paths, edges).groupBy(F.col("goal").alias("id")).agg(F.max("reward").alias("path_reward"))
    own = seeds.select("id", F.lit(1.0).alias("_own")).distinct()
    return candidates.select("id").distinct().join(best, "id", "left").join(own, "id", "left").select("id", F.coalesce("_own", "path_reward", F.lit(0.0)).alias("path_reward"))
