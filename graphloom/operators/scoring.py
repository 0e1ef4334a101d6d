"""Recency, decay, base and final scores (C15-C18) and entity merge pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import vector
from graphloom.operators import blocks, vectors

HALF_LIFE = 30 * 86_400
# Weights of similarity, centrality, recency; of base, mindset, path reward.
BASE, FINAL = (0.5, 0.3, 0.2), (0.7, 0.15, 0.15)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else F.lit(x) if isinstance(x, (int, float)) else x


def recency(timestamp, now: int, half_life: int = HALF_LIFE) -> Column:
    """0.5^(age / half-life); 1 if the half-life is 0; a future time stamp has age 0."""
    if half_life == 0:
        return F.lit(1.0)
    return F.pow(F.lit(0.5), F.greatest(F.lit(now) - _c(timestamp), F.lit(0)).cast("double") / float(half_life))


def decayed(nodes: DataFrame, now: int, half_life: int = HALF_LIFE, at_most: float = 0.99) -> DataFrame:
    """``(id, decay_factor)`` of nodes with a time stamp in (0, now] whose factor is below ``at_most``."""
    factor = nodes.where((F.col("timestamp") > 0) & (F.col("timestamp") <= now)).select("id", recency("timestamp", now, half_life).alias("decay_factor"))
    return factor.where(F.col("decay_factor") < at_most)


def base_score(similarity, centrality, recent, weights: tuple = BASE) -> Column:
    return weights[0] * _c(similarity) + weights[1] * _c(centrality) + weights[2] * _c(recent)


def final_score(base, mindset, path_reward, weights: tuple = FINAL) -> Column:
    return weights[0] * _c(base) + weights[1] * _c(mindset) + weights[2] * _c(path_reward)


def merge_pairs(entities: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``(removed, survivor)`` among entities ``(id, content, embedding)`` of one normalised name at cosine >= threshold.

    The lower id survives; an id is removed once, by its least survivor.  Few entities of a name
    are joined; many are met block by block, a block giving one survivor an entity at most.  A
    threshold of 0 or less, which vectors of different lengths reach, takes the join alone.
    """
    keyed = entities.select("id", F.lower(F.trim("content")).alias("key"), "embedding").withColumn("dim", F.coalesce(F.size("embedding"), F.lit(0)))
    id_type = entities.schema["id"].dataType.simpleString()
    many = keyed.where("embedding is not null and dim > 0").groupBy("key", "dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > blocks.SMALL).select("key", "dim")
    many = many if threshold > 0 else many.limit(0)
    few = keyed.join(many, ["key", "dim"], "left_anti")
    by = ["key", "dim"] if threshold > 0 else ["key"]
    left, right = (few.select(F.col("id").alias(n), *by, F.col("embedding").alias(f"{n}_v")) for n in ("survivor", "removed"))
    pairs = left.join(right, by).where("survivor < removed").where(vector.guarded_cosine("survivor_v", "removed_v") >= threshold)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        if len(a) and len(b):
            x, y, ai, bi = blocks.matrix(a["embedding"]), blocks.matrix(b["embedding"]), a["id"].to_numpy(), b["id"].to_numpy()
            order, left = np.argsort(ai, kind="stable"), np.arange(len(bi))
            x, ai = x[order], ai[order]
            for start in range(0, len(ai), blocks.TILE_ROWS):  # by rising id, so the first survivor is the least
                left = left[bi[left] > ai[start]]
                if not len(left):
                    break
                open_ = []
                for part in np.array_split(left, len(left) // blocks.TILE_COLUMNS + 1):
                    near = x[start : start + blocks.TILE_ROWS] @ y[part].T >= threshold
                    first = near.argmax(axis=0)
                    hit = near[first, np.arange(len(part))] & (ai[start + first] < bi[part])
                    out.append((bi[part][hit], ai[start + first[hit]]))
                    open_.append(part[~hit])
                left = np.concatenate(open_)
        return pa.table([np.concatenate(c) for c in zip(*out)], names=["removed", "survivor"])

    rows = keyed.join(many, ["key", "dim"], "left_semi").select("key", "dim", "id", "embedding")
    met = blocks.met(rows, rows, ["key", "dim"], vectors._most_rows(), run, f"removed {id_type}, survivor {id_type}")
    return pairs.select("removed", "survivor").unionByName(met).groupBy("removed").agg(F.min("survivor").alias("survivor"))


def apply_merges(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """Edges redirected from removed to surviving entities; self-loops and repeats that arise are dropped."""
    out = edges
    for end in ("source", "target"):
        out = out.join(merges.select(F.col("removed").alias(end), F.col("survivor").alias("_to")), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return out.where("source <> target").groupBy("source", "target", "edge_type").agg(F.max("weight").alias("weight"))
