"""Entities alike in neighbours and vector, whatever their names, without comparing all pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import vector
from graphloom.operators import blocks, communities, graph, vectors

# The weights of the two parts of the score.
JACCARD_WEIGHT, COSINE_WEIGHT = 0.6, 0.4
SLACK = 1e-9


def sharing(sets: DataFrame, least: float, without: DataFrame | None = None) -> DataFrame:
    """``(a, b)``, a < b: every pair of the sets ``(id, member)`` with Jaccard similarity of at least ``least`` above 0, and some more.

    Prefix filter: with members ordered from rare to frequent, two such sets share one of their
    first ``n - ceil(least x n) + 1`` members, so a frequent member joins only sets that have
    little else.  With ``least`` at or below 0: all pairs that share a member.  Members of
    ``without`` ``(member)`` join no sets.
    """
    first = _prefixes(sets, least)
    first = first if without is None else first.join(without, "member", "left_anti")
    a, b = (first.select("member", F.col("id").alias(x), F.col("n").alias(f"n_{x}")) for x in ("a", "b"))
    sizes = F.least("n_a", "n_b") + SLACK >= least * F.greatest("n_a", "n_b")
    return a.join(b, "member").where((F.col("a") < F.col("b")) & sizes).select("a", "b").distinct()


def _prefixes(sets: DataFrame, least: float) -> DataFrame:
    """``(id, member, n)``: the members by which ``sharing`` joins; ``n`` is the size of the set."""
    sets = sets.distinct()
    often = sets.groupBy("member").agg(F.count(F.lit(1)).alias("often"))
    own = Window.partitionBy("id")
    ranked = sets.join(often, "member").withColumn("n", F.count(F.lit(1)).over(own)).withColumn("at", F.row_number().over(own.orderBy("often", "member")))
    need = F.ceil(F.lit(least) * F.col("n") - SLACK)
    return (ranked.where(F.col("at") <= F.col("n") - need + 1) if least > 0 else ranked).select("id", "member", "n")


def _hot(entities: DataFrame, sets: DataFrame, first: DataFrame, often: DataFrame, threshold: float) -> DataFrame:
    """``(a, b, jaccard, cosine)`` of pairs that reach ``threshold`` among the entities of each member of ``often`` ``(member)``, by their ``first`` ``(id, member)``.

    Sets and vectors go with the entity to the blocks of its member, so only pairs that reach the
    threshold leave a task.  A pair comes once: at the least member of ``often`` that it shares, if
    it shares no other first member, by which ``sharing`` finds it.
    """
    whole = sets.distinct().groupBy("id").agg(F.collect_set("member").alias("members"))
    dim = F.coalesce(F.size("embedding"), F.lit(-1))
    marked = first.join(often.select("member", F.lit(True).alias("hot")), "member", "left")
    of = marked.groupBy("id").agg(F.collect_set(F.when(F.col("hot"), F.col("member"))).alias("hot"), F.collect_set(F.when(F.col("hot").isNull(), F.col("member"))).alias("rare"))
    of = of.where(F.size("hot") > 0).join(whole, "id").join(entities.select("id", F.col("embedding").alias("v"), dim.alias("dim")), "id")
    rows = of.select(F.explode("hot").alias("key"), "id", "members", "hot", "rare", "v", "dim")
    rows = rows.select("key", "id", "members", F.concat("rare", F.filter("hot", lambda m: m < F.col("key"))).alias("before"), "v", "dim")

    def run(a: pa.Table, b: pa.Table, asked: np.ndarray) -> pa.Table:
        ai, bi = a["id"].to_numpy(), b["id"].to_numpy()

        def of_kinds(column, f):  # many entities have equal sets
            (x, xi), (y, yi) = blocks.kinds(a[column].to_numpy()), blocks.kinds(b[column].to_numpy())
            return f(x, y)[xi][:, yi]

        asked = asked & (of_kinds("before", blocks.common) == 0)
        jaccard = of_kinds("members", blocks.jaccard)
        cosine, da, db = np.zeros(jaccard.shape), a["dim"].to_numpy(), b["dim"].to_numpy()
        for d in np.intersect1d(da[da > 0], db):
            i, j = np.nonzero(da == d)[0], np.nonzero(db == d)[0]
            x, y = blocks.matrix(a["v"].take(i)), blocks.matrix(b["v"].take(j))
            n = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]
            dot = x @ y.T
            cosine[np.ix_(i, j)] = np.where(np.isnan(n), 0.0, np.divide(dot, n, out=np.zeros_like(dot), where=n > 0))
        i, j = np.nonzero((JACCARD_WEIGHT * jaccard + COSINE_WEIGHT * cosine >= threshold) & asked)
        return pa.table([np.minimum(ai[i], bi[j]), np.maximum(ai[i], bi[j]), jaccard[i, j], cosine[i, j]], names=["a", "b", "jaccard", "cosine"])

    id_type = entities.schema["id"].dataType.simpleString()
    values = F.size("members") + F.size("before") + F.greatest("dim", F.lit(0))
    return blocks.within(rows, ["key"], values, run, f"a {id_type}, b {id_type}, jaccard double, cosine double")


def pairs(entities: DataFrame, edges: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(a, b, jaccard, cosine, score)`` of all pairs of ``entities`` ``(id, embedding)`` with 0.6 x Jaccard + 0.4 x cosine >= ``threshold``.

    A cosine is at most 1, so the Jaccard similarity of neighbours is at least
    ``(threshold - 0.4) / 0.6``: pairs come from the set join alone, those of a member with more than
    ``blocks.SMALL`` sets from its blocks.  Where that is not above 0
    (thresholds to 0.4) pairs without a common neighbour are added by a blocked search for cosines
    of at least ``threshold / 0.4``.  Repeated ids must be removed before.
    """
    if threshold <= 0:
        raise ValueError("a threshold of 0 or less asks for all pairs")
    near = graph.both_ways(edges).select(F.col("node").alias("id"), F.col("neighbour").alias("member"))
    sets = near.join(entities.select("id").distinct(), "id", "left_semi")
    least = (threshold - COSINE_WEIGHT) / JACCARD_WEIGHT
    first = _prefixes(sets, least)
    often = first.groupBy("member").agg(F.count(F.lit(1)).alias("often")).where(F.col("often") > blocks.SMALL)
    hot = _hot(entities, sets, first, often, threshold)
    found = sharing(sets, least, often)
    if least <= SLACK:
        unit = entities.where("embedding is not null").select("id", vector.normalised("embedding").alias("embedding"))
        alone = vectors.within(unit, threshold / COSINE_WEIGHT - SLACK)
        found = found.unionByName(alone).distinct()
    v = lambda x: entities.select(F.col("id").alias(x), F.col("embedding").alias(f"v_{x}"))
    scored = communities.jaccard(sets, found).join(v("a"), "a").join(v("b"), "b").withColumn("cosine", F.coalesce(vector.full_cosine("v_a", "v_b"), F.lit(0.0)))
    scored = scored.select("a", "b", "jaccard", "cosine").unionByName(hot)
    if least <= SLACK:  # pairs found by their vectors may share a member of many sets as well
        scored = scored.groupBy("a", "b").agg(F.max("jaccard").alias("jaccard"), F.max("cosine").alias("cosine"))
    scored = scored.withColumn("score", JACCARD_WEIGHT * F.col("jaccard") + COSINE_WEIGHT * F.col("cosine"))
    return scored.where(F.col("score") >= threshold).select("a", "b", "jaccard", "cosine", "score")


def clusters(entities: DataFrame, edges: DataFrame, threshold: float = 0.5) -> DataFrame:
    """G14 without names: ``(id, cluster_id)``; pairs link clusters, a cluster is named by its smallest id."""
    links = pairs(entities, edges, threshold).select(F.col("a").alias("source"), F.col("b").alias("target"))
    return entities.select("id").join(graph.connected_components(links), "id", "left").select("id", F.coalesce("component", "id").alias("cluster_id"))
